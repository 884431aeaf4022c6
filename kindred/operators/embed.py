"""From records to vectors: embedders, reindexing and embedding gaps.

An embedder turns ``(record_id, text)`` rows into ``(record_id, embedding, error)``
rows; anything with such an ``embed`` method will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import record_text
from kindred.operators.upsert import changed_since, upsert_embeddings


class Embedder(Protocol):
    def embed(self, texts: DataFrame) -> DataFrame: ...


class HashingEmbedder:
    """Hashed bag of words on unit length: deterministic, offline, JVM-side."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: DataFrame) -> DataFrame:
        words = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
        counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=self.dim)
        unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
        df = texts.select("record_id", F.coalesce("text", F.lit("")).alias("text"))
        for stage in (words, counts, unit):
            df = stage.transform(df)
        return df.select("record_id", vector_to_array("_unit", "float32").alias("embedding"),
                         F.lit(None).cast("string").alias("error"))


class BatchEmbedder:
    """Wraps a function from a list of texts to vectors; runs it in Arrow batches.

    A batch that fails is retried text by text, so one bad record costs its own
    row only and comes back with ``error`` set.
    """

    def __init__(self, fn: Callable[[Sequence[str]], Sequence[Sequence[float]]]):
        self.fn = fn

    def embed(self, texts: DataFrame) -> DataFrame:
        fn = self.fn

        def one(text: str) -> tuple[np.ndarray | None, str | None]:
            try:
                return np.asarray(fn([text])[0], dtype=np.float32), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                batch = pdf["text"].tolist()
                try:
                    done = [(np.asarray(v, dtype=np.float32), None) for v in fn(batch)]
                except Exception:
                    done = [one(t) for t in batch]
                yield pd.DataFrame({"record_id": pdf["record_id"],
                                    "embedding": [v for v, _ in done],
                                    "error": [e for _, e in done]})

        return texts.select("record_id", "text").mapInPandas(
            run, "record_id string, embedding array<float>, error string")


def _texts(records: DataFrame) -> DataFrame:
    raw = F.col("raw_content") if "raw_content" in records.columns else None
    return records.select("record_id", record_text(
        *[F.col(c) for c in ("given_name", "family_name", "event_year", "location")], raw
    ).alias("text"))


def embed_records(records: DataFrame, embedder: Embedder | None, model_id: str, at) -> DataFrame:
    """(record_id, embedding, model_id, updated_at, error) for rows that want a vector.

    Rows whose ``compute_embedding`` is false are left out; without an embedder
    nothing is embedded.
    """
    if "compute_embedding" in records.columns:
        records = records.where(F.coalesce("compute_embedding", F.lit(True)))
    if embedder is None:
        records = records.limit(0)
        embedder = HashingEmbedder(1)
    return embedder.embed(_texts(records)).select(
        "record_id", "embedding", F.lit(model_id).alias("model_id"),
        F.lit(at).cast("timestamp").alias("updated_at"), "error")


class Reindexed(NamedTuple):
    embeddings: DataFrame
    report: DataFrame
    errors: DataFrame


def reindex(records: DataFrame, embeddings: DataFrame, embedder: Embedder, model_id: str, at,
            since=None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Reindexed:
    """Embed all records changed since a time again and upsert their vectors.

    Records that fail are reported and keep their old vector. ``keep`` may
    materialise the new vectors (``lineage.durable``) so that a costly embedder
    runs once for the three results.
    """
    stored = [c for c in records.columns if c not in ("raw_content", "compute_embedding")]
    changed = changed_since(records.select(*stored), since, ordered=False)
    new = keep(embed_records(changed, embedder, model_id, at))
    ok, failed = new.where("error is null"), new.where("error is not null")
    report = new.agg(
        F.count("*").alias("records_processed"),
        F.count_if(F.col("error").isNull()).alias("chunks_written"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"))
    errors = failed.select("record_id", F.concat_ws(": ", "record_id", "error").alias("error"))
    merged = upsert_embeddings(embeddings, ok.drop("error").withColumn("arrival", F.lit(0)), at)
    return Reindexed(merged, report, errors)


def embedding_gaps(records: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Records that have no vector."""
    return records.join(embeddings.select("record_id"), "record_id", "left_anti")


def fill_gaps(records: DataFrame, embeddings: DataFrame, embedder: Embedder, model_id: str,
              at) -> DataFrame:
    """The embeddings plus vectors for the records that lacked one."""
    new = embed_records(embedding_gaps(records, embeddings), embedder, model_id, at)
    return embeddings.unionByName(new.where("error is null").drop("error"))
