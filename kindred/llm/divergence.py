"""How far the word frequencies of a source lie from those of the other sources and of its language.

Two passes over the texts. The first counts the documents of every (lang, term) and keeps the terms of at least
LEAST documents. The kept terms of a language are dealt to shards by hash, and each shard gets a minimal perfect hash with its
terms stored in slot order. The second pass has the shards at hand: it looks terms up, compares them with the stored
ones, and adds their occurrences to dense arrays, one per group and shard, by slot. Shards go out in blocks of at most
BLOCK bytes; a block is one reading of the texts.

A probability is an integer, p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)); the divergence of a term is
floor((p - q)**2 / (p + q)).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kindred.llm.stores import stored
from kindred.llm.words import BASE, bytes_of, mixed, slices

LEAST, SCALE, RANKS = 10, 10**9, 10
#: Terms are runs of ASCII letters and of bytes of other characters, A-Z lower-cased.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: The seed of Spark's xxhash64.
SEED = 42
#: Terms of a shard; fewer where a language has many sources, so that shard x sources stays under CELLS.
SHARD, CELLS = 1 << 15, 1 << 20
#: Bytes of shards that are broadcast at once.
BLOCK = 96 << 20
#: Distinct counted terms, and bytes of dense arrays, that a task holds.
HELD, DENSE = 300_000, 96 << 20


class PerfectHash:
    """A minimal perfect hash: a place of its own in 0..n-1 for each of n distinct 64-bit numbers, any place for others.

    By levels: what is alone in its cell of a bit array of twice the size is placed, the rest goes on to the next
    level. A place is the number of set bits before the own one.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # boolean arrays
        self.ranks, n = [], 0
        for bits in levels:
            self.ranks.append((np.cumsum(bits) + (n - 1)).astype(np.int32))
            n = int(self.ranks[-1][-1]) + 1
        self.n = n

    @staticmethod
    def _cell(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(h + np.uint64((level + 1) * BASE % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, h: np.ndarray) -> PerfectHash:
        levels = []
        while len(h):
            cell = cls._cell(h, len(levels), 2 * len(h))
            levels.append(np.bincount(cell, minlength=2 * len(h)) == 1)
            h = h[~levels[-1][cell]]
        return cls(levels)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each number, -1 where no level has one."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            cell = self._cell(h[left], level, len(bits))
            hit = bits[cell]
            out[left[hit]] = rank[cell[hit]]
            left = left[~hit]
        return out


class Shard:
    """Terms with a perfect hash over them; ``terms[i]`` is the one in slot i."""

    def __init__(self, seed: int, sizes: list[int], bits: bytes, stops: bytes, terms: bytes):
        flat = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        cuts = np.cumsum(sizes)
        self.hash = PerfectHash([flat[b - n:b] for n, b in zip(sizes, cuts, strict=True)])
        self.seed, self.cuts, self.terms = seed, np.append(np.int32(0), np.frombuffer(stops, np.int32)), terms

    @staticmethod
    def packed(terms: list[bytes]) -> tuple[int, list[int], bytes, bytes, bytes]:
        """What the constructor takes, of distinct terms: hashed with the first seed that tells all apart."""
        seed = SEED
        while True:
            h = np.fromiter((xxh64_intdigest(t, seed) for t in terms), np.uint64, len(terms))
            if len(np.unique(h)) == len(h):
                break
            seed += 1
        perfect = PerfectHash.of(h)
        place = perfect(h)
        order = np.empty(len(terms), np.int64)
        order[place] = np.arange(len(terms))
        placed = [terms[i] for i in order]
        stops = np.cumsum([len(t) for t in placed], dtype=np.int32)
        return seed, [len(x) for x in perfect.levels], np.packbits(np.concatenate(perfect.levels)).tobytes(), stops.tobytes(), b"".join(placed)

    def words(self) -> list[bytes]:
        cuts = self.cuts.tolist()
        return [self.terms[a:b] for a, b in pairwise(cuts)]

    def slots(self, terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 for those that are not stored. ``hashes``: with SEED."""
        if self.seed != SEED:
            hashes = np.fromiter((xxh64_intdigest(t, self.seed) for t in terms), np.uint64, len(terms))
        slot = self.hash(hashes)
        place = np.maximum(slot, 0)
        start, stop, own = self.cuts[place], self.cuts[place + 1], self.terms
        real = [own[a:b] == t for a, b, t in zip(start.tolist(), stop.tolist(), terms, strict=True)]
        return np.where(np.array(real, bool) & (slot >= 0), slot, -1)


def terms_of(text: bytes | None) -> list[bytes]:
    """``bytes.lower`` changes A-Z only."""
    return TERM.findall(text.lower()) if text else []


def _document_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, term, documents of this task that have it), in parts."""
    held: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(counts)), pa.array(list(counts), pa.binary()).cast(pa.string()),
                                              pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n"])
        held.clear()

    for b in slices(batches):
        for lang, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), strict=True):
            held.setdefault(lang, Counter()).update(set(terms_of(text)))
        if sum(map(len, held.values())) >= HELD:
            yield from out()
    yield from out()


def _shard(rows: pa.Table) -> pa.Table:
    terms = rows.column("term").cast(pa.binary()).to_pylist()
    seed, sizes, bits, stops, text = Shard.packed(terms)
    return pa.table({"lang": rows.column("lang").slice(0, 1), "shard": rows.column("shard").slice(0, 1), "shards": rows.column("shards").slice(0, 1),
                     "terms": pa.array([len(terms)], pa.int64()), "seed": pa.array([seed], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                     "bits": pa.array([bits], pa.binary()), "stops": pa.array([stops], pa.binary()), "text": pa.array([text], pa.binary())})


SHARDS = "lang string, shard long, shards long, terms long, seed long, sizes array<long>, bits binary, stops binary, text binary"


def shards_of(kept: DataFrame, groups: DataFrame, shard: int = SHARD, cells: int = CELLS) -> DataFrame:
    """``kept`` (lang, term), ``groups`` (lang, source) -> one row per shard of about ``shard`` terms of one language."""
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    room = F.greatest(F.lit(64), F.least(F.lit(shard), F.floor(F.lit(cells) / F.col("sources"))))
    dealt = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")).join(sources, "lang").select("lang", F.ceil(F.col("v") / room).alias("shards"))
    own = kept.join(dealt, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    return own.select("lang", "shard", "shards", "term").groupBy("lang", "shard").applyInArrow(_shard, SHARDS)


def _recount(shared):
    """(lang, source, text) -> (lang, source, shard, slot, n): the occurrences of this task, in parts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {key: Shard(*row) for key, row in shared.value["shards"].items()}
        number = shared.value["numbers"]
        seen: dict[tuple[str, str], Counter] = {}
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def add() -> None:
            for (lang, source), counts in seen.items():
                terms = list(counts)
                if not terms:
                    continue
                h = np.fromiter((xxh64_intdigest(t, SEED) for t in terms), np.uint64, len(terms))
                n = np.fromiter(counts.values(), np.int64, len(terms))
                shard = h.view(np.int64) % number[lang]
                order = np.argsort(shard, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    k = int(shard[some[0]])
                    own = shards.get((lang, k))
                    if own is None:
                        continue  # of another block
                    slot = own.slots([terms[i] for i in some.tolist()], h[some])
                    real = slot >= 0
                    if (lang, source, k) not in dense:
                        dense[lang, source, k] = np.zeros(own.hash.n, np.int64)
                    dense[lang, source, k][slot[real]] += n[some][real]
            seen.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source, k), counts in dense.items():
                slot = np.flatnonzero(counts)
                if len(slot):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(slot)), pa.repeat(pa.scalar(source, pa.string()), len(slot)),
                                                      pa.array(np.full(len(slot), k)), pa.array(slot), pa.array(counts[slot])], ["lang", "source", "shard", "slot", "n"])
            dense.clear()

        for b in slices(batches):
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), bytes_of(b.column(2)), strict=True):
                if lang in number:
                    seen.setdefault((lang, source), Counter()).update(terms_of(text))
            if sum(map(len, seen.values())) >= HELD:
                add()
                if sum(x.nbytes for x in dense.values()) >= DENSE:
                    yield from out()
        add()
        yield from out()

    return count


def counts_of(docs: DataFrame, shards: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` (lang, source, text), ``shards`` -> (lang, source, shard, slot, n): the occurrences of every kept term that a group has.

    Driver and tasks see ``block`` bytes of shards at once (but for a single larger shard); each block is one reading of ``docs``.
    """
    spark = docs.sparkSession
    size = (F.length("text") + F.length("stops") + F.length("bits")).alias("size")
    sizes = shards.select("lang", "shard", "shards", size).orderBy("lang", "shard").collect()  # a row per shard of some 30,000 terms
    numbers = {r["lang"]: r["shards"] for r in sizes}
    blocks, room = [], 0
    for r in sizes:
        if r["size"] > room:
            blocks.append([])
            room = block
        blocks[-1].append((r["lang"], r["shard"]))
        room -= r["size"]
    schema = "lang string, source string, shard long, slot long, n long"
    out = spark.createDataFrame([], schema)
    for names in blocks:
        first, last = [F.struct(F.lit(lang).alias("lang"), F.lit(k).cast("long").alias("shard")) for lang, k in (names[0], names[-1])]
        own = shards.where(F.struct("lang", "shard").between(first, last))
        rows = {(r["lang"], r["shard"]): (r["seed"], r["sizes"], bytes(r["bits"]), bytes(r["stops"]), bytes(r["text"])) for r in own.collect()}
        shared = spark.sparkContext.broadcast({"shards": rows, "numbers": {lang: numbers[lang] for lang, _ in rows}})  # at most ``block`` bytes
        part = docs.mapInArrow(_recount(shared), schema).groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))
        out = out.union(stored(part, "recount"))
        shared.unpersist()
    return out


def probability(count: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * v)), exact for totals up to 2**63 / 1000: SCALE is three steps of 1000."""
    left, out = count + 2, np.zeros(len(count), np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // (total + 2 * v)
        left = left % (total + 2 * v)
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compare(ranks: int):
    """The counts of a shard and its terms -> partial sums of source pairs, and the shard's leading terms of each source."""

    def compare(key: tuple[pa.Scalar, ...], counts: pa.Table, shard: pa.Table) -> pa.Table:
        lang, own = key[0].as_py(), shard.to_pylist()[0]
        words = Shard(own["seed"], own["sizes"], own["bits"], own["stops"], own["text"]).words()
        groups = sorted((g["source"], g["total"]) for g in own["groups"])
        at = {source: i for i, (source, _) in enumerate(groups)}
        n = np.zeros((len(groups), len(words)), np.int64)
        names = counts.column("source").combine_chunks().dictionary_encode()
        row = np.array([at[s] for s in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
        n[row, counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
        every = probability(n.sum(0), sum(t for _, t in groups), own["v"])
        p = np.stack([probability(n[i], total, own["v"]) for i, (_, total) in enumerate(groups)])
        out: list[tuple[str, str | None, str | None, int]] = []
        for i, (source, _) in enumerate(groups):
            for j in range(i + 1, len(groups)):
                out.append((source, groups[j][0], None, int(divergence(p[i], p[j]).sum())))
            good = np.flatnonzero((n[i] > 0) & (p[i] > every))
            value = divergence(p[i][good], every[good])
            if len(good) > ranks:  # all that reach the value of the last rank
                reach = value >= np.partition(value, -ranks)[-ranks]
                good, value = good[reach], value[reach]
            best = sorted(zip((-value).tolist(), (words[k] for k in good.tolist()), strict=True))[:ranks]
            out += [(source, None, term.decode(), -v) for v, term in best]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), **{c: pa.array(list(x), pa.int64() if c == "value" else pa.string())
                         for c, x in zip(("source", "other", "term", "value"), cols, strict=True)}})

    return compare


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``docs`` (text, lang, source) -> lang, source, part, item, value (long), rank (int, from 1 per lang, source and part).

    part ``pair``: item is each other source of the lang, value the divergence summed over all kept terms of the lang (0 without any). part
    ``term``: item is a kept term that the source has and uses more than the lang as a whole, to rank ``ranks``. Values
    descend, ties go by the UTF-8 bytes of the item. Null texts, langs and sources are ''; every row is a document, repeated ones too;
    an empty table gives an empty one; other columns are ignored.

    The first pass ships each term once per task, the second each (group, term) once per task. A shard is compared in one task; it has
    at most about CELLS counts, unless a language has over 16,000 sources, of which all pairs are the result anyway.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = stored(read.select("lang", "source").distinct(), "audit-groups")
    seen = read.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
    kept = stored(seen.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"), "audit-terms")
    shards = stored(shards_of(kept, groups, shard), "audit-shards")
    counts = counts_of(read, shards, block)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v = shards.groupBy("lang").agg(F.sum("terms").alias("v"))
    roster = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(
        F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))).alias("groups"))  # the sources of a language
    ready = shards.join(roster, "lang").join(v, "lang")
    found = stored(counts.groupBy("lang", "shard").cogroup(ready.groupBy("lang", "shard")).applyInArrow(
        _compare(ranks), "lang string, source string, other string, term string, value long"), "audit-parts")
    halves = found.where("other IS NOT NULL")
    bare = roster.join(shards.select("lang").distinct(), "lang", "left_anti").select("lang", F.explode("groups.source").alias("source"), "groups")
    bare = bare.select("lang", "source", F.explode("groups.source").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    pairs = halves.select("lang", "source", F.col("other").alias("item"), "value").union(
        halves.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "value")).union(bare)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    leading = found.where("term IS NOT NULL").select("lang", "source", F.col("term").alias("item"), "value")
    return _ranked(pairs, "pair", None).union(_ranked(leading, "term", ranks))


def _ranked(rows: DataFrame, part: str, ranks: int | None) -> DataFrame:
    rank: Column = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    out = rows.withColumn("rank", rank)
    out = out if ranks is None else out.where(F.col("rank") <= ranks)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
