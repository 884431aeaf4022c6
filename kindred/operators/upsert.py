"""Merging arrivals into the records and embeddings tables, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.ranking import top_k


def last_arrivals(incoming: DataFrame, key: str = "record_id", order: str = "arrival") -> DataFrame:
    """The latest row per key by ``order`` (any sortable column or struct)."""
    return top_k(incoming, [key], [F.col(order).desc()], 1).drop(order)


def _merge(current: DataFrame, incoming: DataFrame, key: str, fields: list[str],
           on_update: dict[str, Column], on_insert: dict[str, Column]) -> DataFrame:
    """Overwrite ``fields`` of matched rows, append the rest.

    ``incoming`` has one row per key. Matched and new keys are told apart against
    the key column alone, and both joins keep ``current`` on the streamed side: a
    small batch is broadcast by its size and the large table is never shuffled.
    """
    marked = incoming.select(key, F.struct(*fields).alias("_new"))
    updated = current.join(marked, key, "left").select(*[
        F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
        if c in fields else
        F.when(F.col("_new").isNotNull(), on_update[c]).otherwise(F.col(c)).alias(c)
        if c in on_update else F.col(c)
        for c in current.columns])
    known = current.select(key).join(incoming.select(key), key, "left_semi")
    fresh = incoming.join(known, key, "left_anti").select(*[
        F.col(c) if c == key or c in fields else on_insert.get(
            c, F.lit(None)).cast(current.schema[c].dataType).alias(c)
        for c in current.columns])
    return updated.unionByName(fresh)


RECORD_FIELDS = ["given_name", "family_name", "event_year", "birth_year", "location", "source"]


def upsert_records(current: DataFrame, incoming: DataFrame, at, touch: bool = True) -> DataFrame:
    """Insert or overwrite records; the last arrival of an id wins, NULLs overwrite.

    ``incoming`` carries the record fields and ``arrival``. ``created_at`` is kept;
    ``touch=False`` also leaves ``updated_at`` of existing rows alone.
    """
    now = F.lit(at).cast("timestamp")
    return _merge(current, last_arrivals(incoming), "record_id", RECORD_FIELDS,
                  {"updated_at": now} if touch else {}, {"created_at": now, "updated_at": now})


def upsert_embeddings(current: DataFrame, incoming: DataFrame, at) -> DataFrame:
    """Insert or overwrite vectors; the last arrival of an id wins."""
    now = F.lit(at).cast("timestamp")
    return _merge(current, last_arrivals(incoming), "record_id", ["embedding", "model_id"],
                  {"updated_at": now}, {"updated_at": now})


def insert_if_absent(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append rows whose id is not there yet; of several, the first arrival."""
    first = top_k(incoming, ["record_id"], [F.col("arrival").asc()], 1)
    known = current.select("record_id").join(first.select("record_id"), "record_id", "left_semi")
    fresh = first.join(known, "record_id", "left_anti").select(*[
        F.col(c) if c in first.columns else
        F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns])
    return current.unionByName(fresh)


def list_records(records: DataFrame) -> DataFrame:
    return records.select("record_id", "given_name", "family_name", "event_year", "location",
                          "birth_year").orderBy("record_id")


def count_records(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("total"))


def changed_since(records: DataFrame, since=None, ordered: bool = True) -> DataFrame:
    """Records created or updated at or after ``since`` (all when NULL), oldest first."""
    if since is not None:
        t = F.lit(since).cast("timestamp")
        records = records.where((F.col("updated_at") >= t) | (F.col("created_at") >= t))
    return records.orderBy("created_at") if ordered else records
