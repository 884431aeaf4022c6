"""Quality rules as a ledger: every rule is measured once, failures are bits of one long.

``ledger`` gives measurements and a bitmask per document; policies are versioned masks over
the same bits, so a new policy, or what a rule alone decides, needs no second look at the
texts. Everything is column expressions within the row; nothing is shuffled but the counts
of ``ablation``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.common import staged
from kindred.llm.words import BLANK, unused, word_list

#: Words in a window of the repeated-word rule.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rules in bit order. A bit keeps its meaning for ever; new rules are added at the end.
RULES = {
    "few_words": lambda m: m["n_words"] < 20,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "many_symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "few_letters": lambda m: 10 * m["n_letter_words"] < 7 * m["n_words"],
    "shouting": lambda m: 2 * m["n_upper_words"] > m["n_words"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 40 * m["n_words"],
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "full-1": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_letter_words", "n_upper_words")
_UPPER_WORD = (rf"(?<!{BLANK.replace('[', '[^')})[^\p{{Ll}}\p{{Lu}}\x20\x09-\x0D]*+\p{{Lu}}"
               rf"[^\p{{Ll}}\x20\x09-\x0D]*+(?!{BLANK.replace('[', '[^')})")


def mask(policy: str | tuple[str, ...]) -> int:
    """Bits of a policy, given by its version or as rule names."""
    return sum(BITS[r] for r in set(POLICIES[policy] if isinstance(policy, str) else policy))


def _long(c: Column) -> Column:
    return c.cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus a struct column ``ledger``: the MEASURES and ``failed`` (bits), all long.

    A null text counts as empty: all measures 0, only ``few_words`` fails. Repeated rows are
    judged each for itself; an empty table gives an empty one. A column of the input that is
    called ``ledger`` is replaced. Windows are compared by 64-bit hashes chained over their words.
    """
    own = unused(docs, "own_text", "own_words", "own_lines", "own_windows", "own_sorted", "own_places", "own_measures")
    text_, words_, lines_, windows_, sorted_, places_, measures_ = own
    t, w, lines, h = F.col(text_), F.col(words_), F.col(lines_), F.col(windows_)
    df = docs.withColumn(text_, F.coalesce(F.col(text), F.lit(""))).drop("ledger")
    df = staged(df, {words_: word_list(t),
                     lines_: F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)})
    n = F.size(w)
    none = F.array().cast("array<bigint>")
    df = staged(df, {windows_: F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(none)})
    # most texts repeat no window; only the others are sorted
    df = staged(df, {sorted_: F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(
        h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))})
    s = F.col(sorted_)
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    beside = F.arrays_zip(s.alias("x"), F.concat(nothing, F.slice(s, 1, F.size(s) - 1)).alias("before"),
                          F.concat(F.slice(s, 2, F.size(s)), nothing).alias("after"))
    places = F.array_sort(F.transform(
        F.filter(beside, lambda z: z["x"]["h"].eqNullSafe(z["before"]["h"]) | z["x"]["h"].eqNullSafe(z["after"]["h"])),
        lambda z: z["x"]["i"]))
    df = staged(df, {places_: F.coalesce(places, F.array().cast("array<int>"))})
    at = F.col(places_)
    covered = F.aggregate(F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
                          F.lit(0).cast("long"), lambda total, x: total + x)
    df = staged(df, {measures_: F.struct(
        _long(n).alias("n_words"),
        _long(F.length(F.array_join(w, ""))).alias("word_chars"),
        _long(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        _long(F.size(lines)).alias("n_lines"),
        _long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        _long(F.regexp_count(t, F.lit(r"\p{L}[^\x20\x09-\x0D]*"))).alias("n_letter_words"),
        _long(F.regexp_count(t, F.lit(_UPPER_WORD))).alias("n_upper_words"))})
    m = F.col(measures_)
    failed = F.lit(0).cast("long")
    for name, rule in RULES.items():
        failed = failed + F.when(rule(m), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long")
    return (df.withColumn("ledger", F.struct(*[m[x].alias(x) for x in MEASURES], failed.alias("failed")))
            .drop(*own))


def kept(policy: str | tuple[str, ...], failed: str = "ledger.failed") -> Column:
    """Whether a policy keeps the document: none of its bits is set."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(judged: DataFrame, policies: dict[str, tuple[str, ...]] | None = None, failed: str = "ledger.failed") -> DataFrame:
    """What each rule does in each policy, from the stored bits alone.

    One row per (policy, rule): ``n_docs``, ``n_rejected`` by the policy, ``n_failed`` the rule,
    ``n_only`` documents that no other rule of the policy rejects, ``met_rules`` the OR of the
    bits of the documents that fail the rule. An empty table gives zeros.
    """
    bits = judged.groupBy(F.col(failed).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    asked = judged.sparkSession.createDataFrame(
        [(p, r, mask(rules), BITS[r]) for p, rules in (policies or POLICIES).items() for r in rules],
        "policy string, rule string, mask long, bit long")
    b, m, one = F.col("bits"), F.col("mask"), F.col("bit")
    hit = b.bitwiseAND(m)
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    # at most 2 ** len(RULES) distinct masks meet at most policies x rules questions
    return (asked.join(F.broadcast(bits), F.lit(True), "left").groupBy("policy", "rule").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), count(hit != 0).alias("n_rejected"),
        count(b.bitwiseAND(one) != 0).alias("n_failed"), count(hit == one).alias("n_only"),
        F.coalesce(F.bit_or(F.when(b.bitwiseAND(one) != 0, b)), F.lit(0)).alias("met_rules")))
