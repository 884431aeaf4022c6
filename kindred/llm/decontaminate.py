"""Benchmark passages in documents, found by spaced seeds.

A mask of ones and zeros is laid over consecutive words: only the words under ones are
hashed, so a changed word under a zero does not hide a passage. Hashes that a document shares
with a benchmark item are hits; around each the two are compared word by word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kindred.llm.words import Pack, mixed, packs

#: Words under a one are hashed; between them the masks leave out each place at least once.
MASKS = ("111011", "1100101001", "10100010111", "1101000100101")
#: A passage: so many consecutive words (or a whole shorter item), of which SAME in 100 are equal.
STRETCH, SAME = 13, 80
#: Items of fewer words are too common to be a leak and match nothing.
LEAST = 5
#: Words of benchmark items that are broadcast at once (about 100 bytes each, seeds included).
BLOCK_WORDS = 200_000

_TOKEN = re.compile(r"\w+")
RESULT = "doc_id {kind}, item_id {item}, start int, stop int, same int, length int"


def tokens(text: bytes | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _TOKEN.findall(text.decode().lower()) if text else []


def _hash(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, tokens), np.uint64, len(tokens))


def _under(mask: str, words: np.ndarray) -> np.ndarray:
    """Hash of the words under the mask's ones, for each place it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out += words[i:i + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1)
    return mixed(out)


def short_masks(n: int) -> list[str]:
    """Masks over a whole item of fewer than STRETCH words: whichever words SAME allows to differ, one mask leaves them all out.

    For one word that is each place in turn. For two, the item is cut into four parts, and each two of them in turn.
    """
    differ = n * (100 - SAME) // 100
    if not differ:
        return ["1" * n]
    parts = np.array_split(np.arange(n), n if differ == 1 else 2 * differ)
    return ["".join("0" if any(i in parts[j] for j in left_out) else "1" for i in range(n)) for left_out in combinations(range(len(parts)), differ)]


class Seeds:
    """Benchmark items (id, word hashes) and, per mask, their sorted hashes with a small lookup table."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.items = [x for x in items if len(x[1]) >= LEAST]
        self.masks: dict[str, tuple[np.ndarray, np.ndarray, int, dict]] = {}
        found: dict[str, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for k, (_, words) in enumerate(self.items):
            for mask in MASKS if len(words) >= STRETCH else short_masks(len(words)):
                for q, h in enumerate(_under(mask, words).tolist()):
                    found[mask][h].append((k, q))
        for mask, places in found.items():
            keys = np.array(sorted(places), np.uint64)
            bits = max(16, int(len(keys) * 64 - 1).bit_length())
            table = np.zeros(1 << bits, bool)
            table[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.masks[mask] = keys, table, 64 - bits, dict(places)

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in ``words``, item, place in the item) of equal masked hashes."""
        for mask, (keys, table, shift, places) in self.masks.items():
            own = _under(mask, words)
            maybe = np.flatnonzero(table[(own >> np.uint64(shift)).astype(np.int64)])
            if len(maybe):
                at = np.minimum(np.searchsorted(keys, own[maybe]), len(keys) - 1)
                for p in maybe[keys[at] == own[maybe]].tolist():
                    for k, q in places[int(own[p])]:
                        yield p, k, q


def best_stretch(words: np.ndarray, item: np.ndarray, offset: int) -> tuple[int, int, int, int] | None:
    """(start, stop, equal words, length) of the longest passage with the item's word 0 at ``offset``.

    Every stretch of STRETCH words (the item, if shorter) with at least SAME in 100 equal ones counts;
    overlapping ones are joined, and the union's outer unequal words go. None if there is none.
    """
    a, b = max(0, offset), min(len(words), offset + len(item))
    size = min(STRETCH, len(item))
    if b - a < size:
        return None
    equal = words[a:b] == item[a - offset:b - offset]
    total = np.concatenate(([0], np.cumsum(equal)))
    good = np.flatnonzero(100 * (total[size:] - total[:-size]) >= SAME * size)
    if not len(good):
        return None
    cut = np.flatnonzero(np.diff(good) > size)
    runs = zip(good[np.concatenate(([0], cut + 1))], good[np.concatenate((cut, [len(good) - 1]))] + size, strict=True)
    found = []
    for s, e in runs:
        inside = np.flatnonzero(equal[s:e])
        s, e = s + inside[0], s + inside[-1] + 1
        found.append((int(total[e] - total[s]), int(s + a), int(e + a)))
    same, s, e = max(found, key=lambda x: (x[0], -x[1]))
    return s, e, same, e - s


def matches(pack: Pack, seeds: Seeds) -> Iterator[tuple[int, int, tuple]]:
    """(text of the pack, item, best stretch) for every text and item that share a passage."""
    tried, best = set(), {}
    for p, k, q in seeds.hits(pack.words):
        d = int(pack.owner(np.array([p]))[0])
        if (d, k, p - q) in tried:
            continue
        tried.add((d, k, p - q))
        have = best.get((d, k))
        if have and have[2] == len(seeds.items[k][1]):
            continue  # the whole item, word for word: nothing better can follow
        found = best_stretch(pack.words[pack.start[d]:pack.start[d + 1]], seeds.items[k][1], p - q - int(pack.start[d]))
        if found and (not have or (found[2], -found[0]) > (have[2], -have[0])):
            best[d, k] = found
    for (d, k), found in sorted(best.items()):
        yield d, k, found


def find(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Passages of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text): one row per document row and item.

    start, stop: words of the document (exclusive stop); same: equal words among them; length:
    words between its outermost equal ones. A passage has STRETCH words or is the whole of a shorter item,
    with SAME in 100 equal, after lower-casing and without punctuation.
    Null or empty texts, and items under LEAST words, match nothing. Repeated documents give
    repeated rows; equal items all match. Empty tables give an empty result; further columns are ignored.

    Documents are read in place, nothing is shuffled. The benchmark goes out in blocks of about
    ``block_words`` words, so a broadcast is bounded (but for a single longer item) however large the benchmark is.
    """
    spark = docs.sparkSession
    bench = benchmark.select("item_id", F.col("text").alias("text")).where("text IS NOT NULL")
    size = bench.agg(F.sum(F.regexp_count("text", F.lit(r"\w+")))).first()[0] or 0
    blocks = max(1, -(-size // block_words))
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = RESULT.format(kind=kind, item=item)
    read, out = docs.select("doc_id", F.col("text").alias("text")), None
    for block in range(blocks):
        own = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        # bounded: one block of the benchmark, about block_words words
        seeds = Seeds([(r[0], _hash(tokens(r[1].encode()))) for r in own.orderBy("item_id", "text").collect()])
        part = read.mapInArrow(_finder(spark.sparkContext.broadcast(seeds), schema, spark), schema)
        out = part if out is None else out.union(part)
    return out


def _finder(shared, schema: str, spark):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for pack in packs(batches, split=tokens):
            rows = [(pack.rows[d][0], seeds.items[k][0], s, e, same, len(seeds.items[k][1]))
                    for d, k, (s, e, same, _) in matches(pack, seeds)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return search


def leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Distinct doc_id of the documents that hold a benchmark passage."""
    return find(docs, benchmark).select("doc_id").distinct()
