"""Line dedup with an edit bound: deletion neighbourhoods, joined as hashed keys.

Lines are compared by their words. Two lines are within one edit (a word put in, left out or replaced) exactly
if leaving out one word of either or both makes them equal, so a line is met through its
deletion variants. Whole neighbourhoods are made only for lines that may have a partner: a first join on the
untouched half of the variants (four keys per line) tells which.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kindred.llm.stores import Sieve, stored
from kindred.llm.words import BASE, UNBASE, bytes_of, doc_key, mixed, powers, slices

#: Lines of fewer words only have equal partners: one edit would change too much of them.
LEAST = 10
LINE = "line long, doc long, row long, at int, keys array<long>"


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of the halves that an edit leaves alone, as the line itself and with one word left out.

    A variant of m words is met by its length and one half: its first m // 2 words if the word that was left out
    stood behind them, else the others.
    """
    n = len(words)
    keys = []
    for m, skip in ((n, 0), (n - 1, 1)):
        h = m // 2
        keys += [signed(xxh64_intdigest(b"%d<" % m + b" ".join(words[:h]))),
                 signed(xxh64_intdigest(b"%d>" % m + b" ".join(words[h + skip:])))]
    return keys


def line_words(text: bytes | None) -> Iterator[tuple[int, list[bytes]]]:
    """(line number, words) of the lines that have words; lines end at \\n."""
    for at, line in enumerate(text.split(b"\n") if text else ()):
        words = line.split()
        if words:
            yield at, words


def _lines(least: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            docs, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, row, text in zip(docs, rows, bytes_of(b.column(2)), strict=True):
                for at, words in line_words(text):
                    out[0].append(signed(xxh64_intdigest(b" ".join(words))))
                    out[1].append(doc)
                    out[2].append(row)
                    out[3].append(at)
                    out[4].append(half_keys(words) if len(words) >= least else None)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (
                pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["line", "doc", "row", "at", "keys"])
    return read


def _texts(sieve: Sieve):
    """(line, doc, at, text) of the lines that the sieve lets through, by line hash and document."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(xxh64_intdigest(joined), doc, at, joined) for doc, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), strict=True)
                     for at, words in line_words(text) for joined in (b" ".join(words),)]
            lines = np.array([f[0] for f in found], np.uint64).view(np.int64)
            docs = np.array([f[1] for f in found], np.int64)
            some = np.flatnonzero(sieve.holds((lines ^ docs).view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines[some]), pa.array(docs[some]), pa.array([found[i][2] for i in some], pa.int32()),
                 pa.array([found[i][3] for i in some], pa.binary()).cast(pa.string())], ["line", "doc", "at", "text"])
    return read


def variants(words: list[bytes]) -> np.ndarray:
    """Hashed keys of a line's neighbourhood: each variant with the place left out, and the line itself in each place it fits.

    Lines that share a key are within one edit of each other: they differ in the word at one place, or one has it in addition.
    """
    n = len(words)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    weighted = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(n))))
    without = weighted[:-1] + (weighted[-1:] - weighted[1:]) * np.uint64(UNBASE)
    place = mixed(np.arange(1, n + 2, dtype=np.uint64) * np.uint64(BASE))
    size = [np.uint64(m * UNBASE % 2**64) for m in (n - 1, n)]
    return mixed(np.concatenate((without + size[0] ^ place[:n], weighted[-1:] + size[1] ^ place)))


def _variants(sieve: Sieve | None):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, ats = b.column(0).to_pylist(), b.column(1).to_pylist()
            held, size = [], 0
            for i, text in enumerate(bytes_of(b.column(2))):
                keys = variants(text.split())
                if sieve is not None:
                    keys = keys[sieve.holds(keys)]
                held.append((keys, docs[i], ats[i]))
                size += len(keys)
                if size > 200_000:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)
    return emit


def _rows(held: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
    n = [len(k) for k, _, _ in held]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([k for k, _, _ in held]).view(np.int64)), pa.array(np.repeat(np.array([d for _, d, _ in held], np.int64), n)),
         pa.array(np.repeat(np.array([a for _, _, a in held], np.int32), n))], ["key", "doc", "at"])


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word put in, left out or replaced, or nothing, turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [within_one_edit(x.split(), y.split()) for x, y in zip(bytes_of(b.column(1)), bytes_of(b.column(2)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], ["line"])


def near_lines(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(line): lines, given by hash, that an earlier one is within one edit of.

    ``lines``: line, doc, at (the first place of each), keys; ``texts``: doc, row, text. Keys only ever meet in minima,
    which are summed up map-side; a key that very many lines share is no group to be held.
    """
    keys = lines.where("keys IS NOT NULL").select("line", F.explode("keys").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("key"), "line-keys")
    some = keys.where(Sieve(shared).column(F.col("key"))).join(shared, "key", "left_semi").select("line").distinct()
    wanted = stored(lines.select("line", "doc", "at").join(some, "line", "left_semi"), "line-wanted")
    sieve = Sieve(wanted.select(F.col("line").bitwiseXOR(F.col("doc"))))
    found = texts.select("doc", "text").mapInArrow(_texts(sieve), "line long, doc long, at int, text string")
    asked = stored(found.join(wanted, ["line", "doc", "at"], "left_semi").dropDuplicates(["line"]), "line-texts")
    schema = "key long, doc long, at int"
    place = F.struct("doc", "at")
    every = asked.select("doc", "at", "text")
    met = stored(every.mapInArrow(_variants(None), schema).groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                 .where("first < last").select("key", "first"), "line-met")
    later = (every.mapInArrow(_variants(Sieve(met.select("key"))), schema).join(met, "key").where(F.col("first") < place)
             .select("doc", "at", "first").distinct())
    this, that = asked.select("line", "doc", "at", "text"), asked.select(F.struct("doc", "at").alias("first"), F.col("text").alias("other"))
    pairs = later.join(this, ["doc", "at"]).join(that, "first").select("line", "text", "other")
    return pairs.mapInArrow(_verified, "line long").distinct()


def _cut(sieve: Sieve | None):
    """Rows (row, text, gone, others ...) -> (n_lines, n_removed, kept, others ...); with a sieve only rows that it stops, whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if sieve is not None:
                rows = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                b = b.filter(pa.array(~sieve.holds(rows)))
            gone_of = b.column(2).to_pylist() if sieve is None else [None] * b.num_rows
            texts, n, removed = [], [], []
            for text, gone in zip(bytes_of(b.column(1)), gone_of, strict=True):
                lines = text.split(b"\n") if text is not None else []
                drop = set(gone or ())
                n.append(len(lines))
                removed.append(len(drop))
                texts.append(text if not drop else b"\n".join(x for i, x in enumerate(lines) if i not in drop))
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), *b.columns[3:]],
                ["n_lines", "n_removed", "kept", *b.schema.names[3:]])
    return run


def dedup(docs: DataFrame, least: int = LEAST, carry: Sequence[str] = ()) -> DataFrame:
    """``docs`` (doc_id, text) -> n_lines, n_removed, kept (text without the removed lines), doc_id, one row per row.

    A line goes if a line before it, by (doc_id, line number), has the same words or, where both have ``least`` words,
    is within one edit of it. Lines are judged on the input, whether or not the earlier line stays; lines
    without words stay. A null text stays null with no lines, an empty one has one blank line. Null doc_ids come last; rows
    with one doc_id have no order among themselves, equal rows get equal results; an empty table gives an empty one; of further columns
    those named in ``carry`` come along. Equal lines are those of one 64-bit hash; near ones are verified word by word.

    Only texts that lose lines are shuffled to meet their line numbers.
    """
    texts = docs.select(doc_key(F.col("doc_id")).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").alias("text"))
    every = stored(texts.mapInArrow(_lines(least), LINE), "lines")
    first = stored(every.groupBy("line").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")), "line-first")
    near = near_lines(first.select("line", "first.doc", "first.at", "keys"), texts)
    # stored, so that the next join can split the partition of a hot line
    judged = stored(first.select("line", "first", "n").join(near.withColumn("near", F.lit(True)), "line", "left").where("n > 1 OR near").drop("n"), "line-judged")
    gone = (every.select("line", "doc", "row", "at").join(judged, "line")
            .where(F.col("near") | (F.struct("doc", "at") != F.col("first")))
            .groupBy("doc", "row").agg(F.collect_set("at").alias("gone")))
    gone = stored(gone, "line-gone")
    other = [F.col(c).alias(f"__{i}") for i, c in enumerate(carry)]
    whole = docs.select(F.xxhash64("doc_id", "text").alias("__row"), doc_key(F.col("doc_id")).alias("__doc"), F.col("text").alias("__text"),
                        F.col("doc_id").alias("__id"), *other)
    gone = gone.select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("gone").alias("__gone"))
    sieve = Sieve(gone.select("__row"))
    out = ["__row", "__text", "__gone", "__id", *[f"__{i}" for i in range(len(carry))]]
    hit = whole.where(sieve.column(F.col("__row"))).join(gone, ["__doc", "__row"], "left").select(*out)
    clear = whole.withColumn("__gone", F.lit(None).cast("array<int>")).select(*out)
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in hit.schema.fields[3:])
    schema = f"n_lines long, n_removed long, kept string{kinds}"
    done = hit.mapInArrow(_cut(None), schema).union(clear.mapInArrow(_cut(sieve), schema))
    return done.select("n_lines", "n_removed", "kept", F.col("__id").alias("doc_id"), *[F.col(f"__{i}").alias(c) for i, c in enumerate(carry)])
