"""Text cleansing: OCR years, place abbreviations, redaction, title case."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.common import is_blank, literal_map, once
from kindred.functions.dims import PLACE_ABBREVIATIONS

Cleanser = Callable[[Column], Column]

# ASCII word boundaries, written out so the result does not hang on the JVM's \b
_NOT_AFTER_WORD = "(?<![A-Za-z0-9_])"
_NOT_BEFORE_WORD = "(?![A-Za-z0-9_])"


def fix_ocr_years(c: Column) -> Column:
    """Repair letters read for digits in four-character year-like words.

    One replacement per letter class. The look-arounds prove that the letter
    sits at position 0..3 of a word made of exactly four year-like characters; they
    stand behind the letter, so that other characters cost one comparison.
    """
    y = "[0-9IlSO]"
    spot = lambda letters: f"[{letters}](?:" + "|".join(
        f"(?<={_NOT_AFTER_WORD}{y * before}[{letters}])(?={y * (3 - before)}{_NOT_BEFORE_WORD})"
        for before in range(4)
    ) + ")"
    for letters, digit in (("S", "5"), ("O", "0"), ("lI", "1")):
        c = F.regexp_replace(c, spot(letters), digit)
    return c


# a run of word characters, or of others: together they are the text
WORD_PIECES = "[A-Za-z0-9_]+|[^A-Za-z0-9_]+"
_ONE_WORD = re.compile("[A-Za-z0-9_]+")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, other characters unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def standardize_location(c: Column, abbreviations: Mapping[str, str] = PLACE_ABBREVIATIONS) -> Column:
    """Spell out place abbreviations: whole words, any ASCII case.

    One search for any of them; texts that have one are cut into words, and each word is replaced once.
    Abbreviations that are no single word go first, one pattern each. ``operators.dimensions.with_places``
    takes a table instead.
    """
    for short in sorted(s for s in abbreviations if not _ONE_WORD.fullmatch(s)):
        full = abbreviations[short].replace("\\", "\\\\").replace("$", "\\$")
        c = F.regexp_replace(c, f"(?i){_NOT_AFTER_WORD}{re.escape(short)}{_NOT_BEFORE_WORD}", full)
    words = {s.lower(): full for s, full in abbreviations.items() if _ONE_WORD.fullmatch(s)}
    if not words:
        return c
    table = literal_map(words)
    spelled = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(WORD_PIECES), F.lit(0)),
                                       lambda x: F.coalesce(F.try_element_at(table, ascii_lower(x)), x)), "")
    return F.when(c.rlike(f"(?i){_NOT_AFTER_WORD}({'|'.join(words)}){_NOT_BEFORE_WORD}"), spelled).otherwise(c)


DEFAULT_CLEANSERS: tuple[Cleanser, ...] = (fix_ocr_years, standardize_location)
_registered: list[Cleanser] = list(DEFAULT_CLEANSERS)


def register_cleanser(fn: Cleanser) -> Cleanser:
    """Append a Column -> Column step to the default chain (usable as a decorator)."""
    _registered.append(fn)
    return fn


def unregister_cleanser(fn: Cleanser) -> None:
    _registered.remove(fn)


def cleanse(c: Column, steps: Sequence[Cleanser] | None = None) -> Column:
    """Run the steps in order as one expression; blank text passes unchanged.

    What a step gets is worked out once, however often the step names it.
    """
    chain = _registered if steps is None else steps
    return F.when(is_blank(c), c).otherwise(reduce(once, chain, c))


# What counts as personal data, in replacement order.
PII_PATTERNS: dict[str, str] = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "phone": r"\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}",
}
REDACTED = "[REDACTED]"


def redact_pii(c: Column) -> Column:
    """Blank out social-security numbers, e-mail addresses and US phone numbers."""
    return reduce(lambda acc, p: F.regexp_replace(acc, p, REDACTED), PII_PATTERNS.values(), c)


def title_case(c: Column) -> Column:
    """Upper-case after every non-letter, so ``o'brien`` gives ``O'Brien``.

    ``initcap`` only breaks on spaces; here every run of letters is one word. A text of letters alone is one.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.when(c.rlike(r"^\p{L}*+\z"), F.initcap(c)).otherwise(F.array_join(F.transform(runs, lambda r: F.initcap(r)), ""))
