"""Scratch tables in the cluster's shared folder, and sieves: set filters of a fixed size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.lineage import scratch_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Sieve:
    """A one-hash Bloom filter over long keys; its size is ``bits`` / 8 bytes, whatever the data.

    It may let foreign keys through (the more, the fuller it is) but never stops a member,
    so it only thins out the rows that go on to an exact join. Members are marked by
    ``bitmap_construct_agg`` on the executors; the driver sees the finished bitmap, at most
    ``bits`` / 8 bytes. Null keys are no members.
    """

    def __init__(self, keys: DataFrame, bits: int = 1 << 26):
        """``keys``: one long column; ``bits``: a power of two of at least 2**15."""
        slot = (F.col(keys.columns[0]).bitwiseAND(F.lit(bits - 1)) + 1).alias("slot")  # positions count from 1
        parts = (keys.select(slot).where("slot IS NOT NULL")
                 .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")))
        table = np.zeros(bits // 8, np.uint8)
        for row in parts.collect():  # at most bits / 32768 rows of 4 KB
            at = (row["bucket"] - 1) * 4096
            table[at:at + 4096] = np.frombuffer(row["bitmap"], np.uint8)
        self.bits = bits
        self.shared = keys.sparkSession.sparkContext.broadcast(table)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (64-bit) may be members."""
        slot = keys.astype(np.uint64) & np.uint64(self.bits - 1)
        byte = self.shared.value[(slot >> np.uint64(3)).astype(np.int64)]
        return (byte >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def __getstate__(self):
        return {"bits": self.bits, "shared": self.shared}

    def column(self, key: Column) -> Column:
        """The same as a boolean column, for a long column without nulls."""
        @F.pandas_udf("boolean")
        def may_hold(values: pd.Series) -> pd.Series:
            return pd.Series(self.holds(values.to_numpy().astype(np.int64).view(np.uint64)))
        return may_hold(key)
