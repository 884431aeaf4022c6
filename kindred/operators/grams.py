"""Which stored words contain a given string: inverted lists from grams to words.

A word is listed under the GRAM characters that start at each of its places (its end is padded). A needle looks up the rarest of
its grams and what it finds there is checked; a needle shorter than a gram meets the grams that begin with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
_PAD = "\x00" * (GRAM - 1)


def _grams(text: Column, places: Column) -> Column:
    at = F.when(places > 0, F.sequence(F.lit(1), places)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))))


def postings(words: DataFrame) -> DataFrame:
    """``words`` (word and other columns) -> a row per distinct gram of each: the columns and ``gram``.

    The size is that of the words' text; the empty word has no row.
    """
    padded = F.concat("word", F.lit(_PAD))
    return words.where("word IS NOT NULL").select("*", F.explode(_grams(padded, F.length("word"))).alias("gram"))


def longest_literal(pattern: Column) -> Column:
    """The longest run of a LIKE pattern without wildcards."""
    return F.array_sort(F.split(pattern, r"[%_\\]"), lambda a, b: F.length(b) - F.length(a))[0]


def lookup(listed: DataFrame, words: DataFrame, needles: DataFrame, by: Sequence[str] = (), wildcards: bool = False) -> DataFrame:
    """(``by``, needle, word) for every word that contains the needle, each once.

    ``words``: distinct (``by``, word); ``listed``: their postings; ``needles``: distinct (``by``, needle). The
    empty needle is in every word. With ``wildcards`` a needle is a LIKE pattern between two ``%``. Nulls match nothing.
    """
    by = list(by)
    n = needles.where("needle IS NOT NULL").withColumn("anchor", longest_literal(F.col("needle")) if wildcards else F.col("needle"))
    size = F.length("anchor")
    sizes = {r[0] for r in n.select(F.least(size, F.lit(GRAM))).distinct().collect()}  # at most GRAM + 1 numbers
    out = None
    for k in sorted(sizes):
        own = n.where(size == k) if k < GRAM else n.where(size >= GRAM)
        if k == 0:
            found = own.join(words.where("word IS NOT NULL"), by) if by else own.crossJoin(words.where("word IS NOT NULL"))  # one needle at most without wildcards
        elif k < GRAM:
            short = listed.select(*by, F.left("gram", F.lit(k)).alias("anchor"), "word").distinct()
            found = own.join(short, [*by, "anchor"])
        else:
            counts = listed.groupBy(*by, "gram").agg(F.count("*").alias("n"))
            grams = own.select(*by, "needle", "anchor", F.explode(_grams(F.col("anchor"), size - (GRAM - 1))).alias("gram"))
            rarest = grams.join(counts, [*by, "gram"], "left").groupBy(*by, "needle", "anchor").agg(
                F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
            found = rarest.join(listed, [*by, "gram"]).where(F.contains("word", "anchor"))
        found = found.select(*by, "needle", "word")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return n.select(*by, "needle", F.lit(None).cast("string").alias("word")).where(F.lit(False))
    return out.where(F.like("word", F.concat(F.lit("%"), "needle", F.lit("%")))) if wildcards else out
