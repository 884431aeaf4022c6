"""Similarity of vectors: reranking, exact and approximate nearest neighbours.

Exact search streams the stored vectors through tasks that hold a block of queries: nothing
of them is shuffled, and a task keeps the best ``k`` per query. Query blocks are broadcast one
after another, each of a bounded number of bytes. Approximate search goes through a stored
index (``ivf``). No pair of vectors is ever a row but for the best ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import snippet
from kindred.functions.vectors import cosine
from kindred.operators.ivf import RECALL, VectorIndex, top_cells
from kindred.operators.lineage import durable, scratch_dir
from kindred.operators.ranking import top_k

#: Bytes of query vectors that are broadcast at once, and answers to them that a task holds.
QUERY_BYTES, HELD = 64 << 20, 2_000_000
#: Stored vectors and scores that a task works on at once: what fits a core's cache.
PIECE, CELLS = 1024, 1 << 20


def similarity_among(candidates: DataFrame, embeddings: DataFrame,
                     query_vectors: DataFrame) -> DataFrame:
    """Candidates with ``vector_similarity``; NULL where either vector is missing."""
    stored = embeddings.select("record_id", "embedding")
    asked = query_vectors.select("query_id", "query_vector")
    return (candidates.join(stored, "record_id", "left").join(asked, "query_id", "left")
            .withColumn("vector_similarity", cosine(F.col("embedding"), F.col("query_vector")))
            .drop("embedding", "query_vector"))


def rerank(candidates: DataFrame, embeddings: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """Order each query's candidates by similarity; missing scores go last.

    Adds ``vector_similarity``, ``new_rank`` and ``rerank_applied``. A query without
    any score keeps its order.
    """
    from pyspark.sql import Window

    per_query = Window.partitionBy("query_id")
    by_score = per_query.orderBy(F.coalesce("vector_similarity", F.lit(-1.0)).desc(), F.col("rank"))
    return similarity_among(candidates, embeddings, query_vectors).withColumns({
        "new_rank": F.row_number().over(by_score),
        "rerank_applied": F.max(F.col("vector_similarity").isNotNull()).over(per_query),
    })


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _merged(best: np.ndarray, names: np.ndarray, row: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> None:
    """Put new scores into ``best`` and ``names`` (a row of ``k`` per query, -inf and None where there is none yet)."""
    some = np.unique(row)
    at = np.concatenate((np.repeat(some, k), row))
    scores, ids = np.concatenate((best[some].ravel(), score)), np.concatenate((names[some].ravel(), name))
    real = scores > -np.inf
    at, scores, ids = at[real], scores[real], ids[real]
    order = np.lexsort((-scores, at))
    at, scores, ids = at[order], scores[order], ids[order]
    # ids are compared only where scores are equal
    equal = (at[1:] == at[:-1]) & (scores[1:] == scores[:-1])
    if equal.any():
        tied = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
        tied_order = np.lexsort((pd.factorize(ids[tied], sort=True)[0], -scores[tied], at[tied]))
        ids[tied] = ids[tied][tied_order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    kept = place < k
    best[at[kept], place[kept]], names[at[kept], place[kept]] = scores[kept], ids[kept]


def _stream_best(shared, k: int, min_score: float):
    """Best ``k`` of a partition's vectors for each query of the broadcast block.

    A score becomes a row only if it reaches the k-th best that its query has by then, so rows thin out as vectors pass.
    """
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, units = shared.value
        scores, names = np.full((len(ids), k), -np.inf), np.full((len(ids), k), None, object)
        for batch in batches:
            batch = batch[batch["vector"].notna()].sort_values("record_id", kind="stable")
            for i in range(0, len(batch), PIECE):
                part = batch.iloc[i:i + PIECE]
                m, own = _unit(part["vector"]), part["record_id"].to_numpy()
                for j in range(0, len(ids), step := max(1, CELLS // PIECE)):
                    beat = np.maximum(scores[j:j + step, -1:], min_score)
                    raw = units[j:j + step] @ m.T
                    # scores count by ten digits, so what is rounded up may still reach
                    cells = np.flatnonzero(raw >= beat - 1e-9)
                    if len(cells) > 2 * k * len(raw):  # the first vectors, or many that are equal: k per query of them
                        row, col = top_cells(np.round(raw, 10), k, beat)
                    else:
                        row, col = np.divmod(cells, raw.shape[1])
                    if len(row):
                        found = np.round(raw[row, col], 10)
                        real = found >= beat[row, 0]
                        _merged(scores, names, row[real] + j, found[real], own[col[real]], k)
        query, place = np.nonzero(scores > -np.inf)
        if len(query):
            yield pd.DataFrame({"query_id": ids[query], "record_id": names[query, place], "score": scores[query, place]})
    return best


def nearest(query_vectors: DataFrame, embeddings: DataFrame, k: int = 5,
            min_score: float = -1.0, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, record_id, score, rank): exact ``k`` nearest by cosine, score >= ``min_score``.

    Reads the stored vectors once per ``query_bytes`` of query vectors (or HELD answers); with more queries than a few such
    blocks ``ann_search`` is the way. Of several blocks each one's result is written to the scratch folder
    before the next is broadcast.
    """
    spark = embeddings.sparkSession
    q = query_vectors.select("query_id", F.col("query_vector").alias("vector")).where("vector is not null")
    e = embeddings.select("record_id", F.col("embedding").alias("vector"))
    n, width = q.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n * (width or 0) * 8 // query_bytes), -(-n * k // HELD))
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, record_id string, score double"
    parts = None
    for b in range(blocks):
        # bounded: about query_bytes of vectors
        own = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        units = _unit(own["vector"]) if len(own) else np.zeros((0, width or 0))
        shared = spark.sparkContext.broadcast((own["query_id"].to_numpy(), units))
        found = e.mapInPandas(_stream_best(shared, k, min_score), schema) if len(own) else spark.createDataFrame([], schema)
        if blocks > 1:
            found = durable(found)
            shared.unpersist()
        parts = found if parts is None else parts.unionByName(found)
    return top_k(parts, ["query_id"], [F.col("score").desc(), F.col("record_id")], k, rank="rank")


def semantic_search(query_vectors: DataFrame, records: DataFrame, embeddings: DataFrame,
                    max_results: int = 5, min_score: float = 0.75,
                    candidate_limit: int | None = None) -> DataFrame:
    """Best stored records per query vector, with a snippet and a metadata map.

    ``candidate_limit=20`` scores only the first rows of an empty search, as an
    interactive endpoint would; the default scores every record.
    """
    if candidate_limit is not None:
        first = (records.orderBy(F.col("family_name") != "", F.col("given_name") != "",
                                 F.col("event_year").asc_nulls_last(), "record_id")
                 .select("record_id").limit(candidate_limit))
        embeddings = embeddings.join(first, "record_id", "left_semi")
    hits = nearest(query_vectors, embeddings, max_results, min_score)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    facts = records.select(
        "record_id",
        snippet(*[F.col(c) for c in
                  ("given_name", "family_name", "event_year", "location")]).alias("snippet"),
        F.create_map(F.lit("givenName"), text("given_name"),
                     F.lit("familyName"), text("family_name"),
                     F.lit("year"), text("event_year"),
                     F.lit("location"), text("location")).alias("metadata"))
    return hits.join(facts, "record_id", "left").select(
        "query_id", "rank", "record_id", "score",
        F.coalesce("snippet", F.lit("")).alias("snippet"), "metadata")


def ann_search(query_vectors: DataFrame, embeddings: DataFrame, k: int = 5, cells: int | None = None,
               recall: float = RECALL, seed: int = 7) -> DataFrame:
    """(query_id, record_id, score, rank): approximate ``k`` nearest by cosine, through an index made for this call.

    For more than one call build a ``VectorIndex`` and keep it.
    """
    index = VectorIndex.build(embeddings, scratch_dir(embeddings.sparkSession, "vectors"), cells, seed)
    return index.search(query_vectors, k, recall)
