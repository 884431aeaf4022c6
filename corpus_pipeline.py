"""From raw documents to a training mix: each stage is one operator of ``kindred.llm``.

A stage takes (spark, docs, sf_dir); ``docs`` has the columns of ``documents``. Every stage but the last returns
them too, and works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontaminate, lines, mixing, quality, simhash
from kindred.llm.stores import stored
from kindred.llm.words import doc_key, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the full quality policy keeps, unchanged."""
    return quality.ledger(docs).where(quality.kept("full-1")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without equal or nearly equal earlier lines; a document that loses every line with words goes.

    ``n_chars`` follows the text.
    """
    left = lines.dedup(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    some = left.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return some.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with doc_key and a hash of the text, and their names: what a decision on a row is joined on.

    Null and repeated doc_ids are told apart by their texts.
    """
    doc, row = unused(docs, "doc", "row")
    return docs.withColumns({doc: doc_key(F.col("doc_id")), row: F.xxhash64("text")}), [doc, row]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash links (three-word shingles, two bits) the first stays, by doc_id and then hash of the text, unchanged.

    Of equal rows with a doc_id all stay: they are one document. Without an id each row is a document: one of equal ones stays.
    """
    rows, on = keyed(docs)
    found = simhash.near_duplicates(rows.select("doc_id", "text", *on), carry=tuple(on))
    firsts = found.groupBy("component").agg(F.min(F.struct(*on)).alias("first")).select("first.*")
    left = stored(rows.join(stored(firsts, "firsts"), on, "left_semi"), "left")
    named, nameless = left.where("doc_id IS NOT NULL"), left.where("doc_id IS NULL").dropDuplicates(on[1:])
    return named.union(nameless).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, unchanged."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, on = keyed(docs)
    leaks = stored(decontaminate.leaking(rows.select(F.struct(*on).alias("doc_id"), "text"), bench), "leaks").select("doc_id.*")
    return rows.join(leaks, on, "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document that is left."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: Fingerprints and the mix's rates are beyond SQL; a brute-force version is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
