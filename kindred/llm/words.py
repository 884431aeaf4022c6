"""Words of texts: column expressions and packed hash arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: What separates words, as a character class of Java, Python and RE2 patterns.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The id that stands for a null doc_id; it sorts last.
NO_ID = 2**63 - 1
#: An odd multiplier for the polynomial hashes below, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 2**64)


def word_count(text: Column) -> Column:
    """Number of words (long); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_list(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def doc_key(doc_id: Column) -> Column:
    """doc_id as a long that is never null; nulls sort last."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, so that few of their texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def bytes_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def split_words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes; ``bytes.split`` splits at exactly the six ASCII blanks."""
    return text.split() if text else []


class Pack:
    """Some texts' word hashes behind one another; ``start[i]:start[i + 1]`` are those of text i."""

    def __init__(self, rows: list[tuple], hashes: list[np.ndarray]):
        self.rows = rows
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in hashes]))).astype(np.int64)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Index of the text that holds each word position."""
        return np.searchsorted(self.start, at, "right") - 1

    def end(self, at: np.ndarray) -> np.ndarray:
        """End of the text that holds each word position."""
        return self.start[self.owner(at) + 1]


def packs(batches: Iterable[pa.RecordBatch], text: str = "text",
          split: Callable[[bytes], list] = split_words, size: int = 100_000) -> Iterator[Pack]:
    """Packs of at least ``size`` words (but the last); texts are never cut."""
    rows, hashes, n = [], [], 0
    for batch in slices(batches):
        others = [batch.column(c).to_pylist() for c in batch.schema.names if c != text]
        texts = bytes_of(batch.column(text))
        for i, t in enumerate(texts):
            w = split(t)
            h = np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w))
            rows.append(tuple(o[i] for o in others))
            hashes.append(h)
            n += len(h)
            if n >= size:
                yield Pack(rows, hashes)
                rows, hashes, n = [], [], 0
    if rows:
        yield Pack(rows, hashes)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolled(words: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every run of ``length`` consecutive words, by doubling."""
    out, width, have, part = None, 0, 1, words
    while True:
        if length & have:
            if out is None:
                out, width = part, have
            else:
                n = len(words) - width - have + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:n] + part[width:width + n] * np.uint64(pow(BASE, width, 2**64))
                width += have
        have *= 2
        if have > length:
            return out
        n = len(words) - have + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        part = part[:n] + part[have // 2:have // 2 + n] * np.uint64(pow(BASE, have // 2, 2**64))
