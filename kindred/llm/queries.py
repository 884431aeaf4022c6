"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.common import staged
from kindred.llm import decontaminate, divergence, licences, lines, mixing, periodic, pii, quality, scoring, simhash, substrings, tokens, urls
from kindred.llm.words import word_list


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in pii.KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark passage, with the item and the place."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, fixed formats and learned ones."""
    found = pii.find(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}")
              for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(_spans(F.col("base")), 256).alias("base_sha256"),
                        _spans(F.array_sort(F.concat("base", "learned"))).alias("spans"),
                        F.size("learned").cast("long").alias("n_learned"))


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failed rules and the verdict of the full policy, per document."""
    judged = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"ledger.{c}").alias(c) for c in own],
                         (~quality.kept("base-1")).alias("base_failed"), quality.kept("full-1").alias("kept"),
                         F.col("ledger.failed").alias("failed_bits"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op6_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of earlier ones."""
    out = substrings.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every document and the known licences that it or a line of it is."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_bk_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without equal or nearly equal earlier lines."""
    out = lines.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hash_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and the terms that set it apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the CRC of its id, repeats some of its words to its end; without an id none does."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(h / 10), F.col("own_words")
    n = F.size(words)
    some = staged(docs, {"own_words": F.when(h % 10 == 0, word_list(F.col("text")))})  # words of the documents to change only
    some = staged(some, {"first": F.when(n > 0, g % n)})
    some = staged(some, {"period": F.floor((n - F.col("first")) / (3 + g % 8)) + 1})
    first, period = F.col("first"), F.col("period")
    repeated = F.transform(words, lambda w, i: F.when(i < first, w).otherwise(F.get(words, (first + (i - first) % period).cast("int"))))
    return some.withColumn("text", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))).select(*docs.columns)


def op12_minimizer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document and what is left of it with one period of each."""
    found = periodic.find(planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
                        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_neural_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of the others."""
    return scoring.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_spaced_seeds, op2_contextual_pii, op3_entropy_mix, op4_rule_ledger, op5_token_counts, op6_seed_extend,
        op7_licence_digests, op8_redirect_filter, op9_bk_simhash, op10_line_edits, op11_hash_recount, op12_minimizer_runs, op13_neural_scores)}
