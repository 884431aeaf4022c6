"""Small column helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# every ASCII control character and the space
_WHITESPACE = "".join(chr(i) for i in range(1, 33))


def trim_ws(c: Column) -> Column:
    """Trim spaces, tabs and line ends (``trim`` alone only takes spaces)."""
    return F.btrim(c, F.lit(_WHITESPACE))


def is_blank(c: Column) -> Column:
    """NULL, empty or only whitespace; never NULL itself."""
    return F.coalesce(trim_ws(c) == "", F.lit(True))


def literal_map(entries: Mapping[str, object]) -> Column:
    """A foldable map column from a small Python mapping."""
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def contains_ci(haystack: Column, needle: Column, wildcards: bool = False) -> Column:
    """Case-insensitive substring test; ``wildcards`` lets ``%`` and ``_`` match."""
    h, n = F.lower(haystack), F.lower(needle)
    if wildcards:
        return F.like(h, F.concat(F.lit("%"), n, F.lit("%")))
    return h.contains(n)


def compact(*items: Column) -> Column:
    """Array of the items that are not NULL, in order."""
    return F.array_compact(F.array(*items))


def rounded(c: Column, places: int) -> Column:
    """``round`` of a double, which goes through a decimal text, for the few values that need that: those near a half or large.

    Elsewhere the nearest whole number of units is the same, and so is the double nearest to its quotient.
    """
    units = c * F.lit(10.0 ** places)
    plain = units.between(-1e10, 1e10) & (F.abs(units - F.floor(units) - F.lit(0.5)) > 1e-3)
    return F.when(plain, (F.rint(units) + F.lit(0.0)) / F.lit(10.0 ** places)).otherwise(F.round(c, places))


def once(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(c)``, where ``c`` is worked out once per row however often ``fn`` names it."""
    return F.transform(F.array(c), lambda x: fn(x))[0]


def staged(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are computed once, here.

    A one-row generator stands between them and what follows, so filters and
    projections further up do not unfold long expressions into one another.
    """
    one_row = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(one_row))
