"""Exact passages that documents share: winnowed anchors, extended both ways.

Of every SPAN consecutive words the k-gram with the smallest hash is the window's anchor. Equal
windows have equal anchors, so documents meet on anchors alone. The windows of one anchor form a run
around it: the stretch that it can be extended to. Runs are compared whole first; where an anchor
has several different runs, one of each kind is compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.stores import Sieve, stored
from kindred.llm.words import BASE, NO_ID, UNBASE, Pack, bytes_of, doc_key, mixed, packs, powers, rolled, slices, split_words

#: Words of a window: the shortest passage that counts.
SPAN = 50
#: Words of an anchor.
GRAM = 12
RUN = "anchor long, run long, doc long, row long, start int, windows int"


def winnow(pack: Pack, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (anchor hash, hash of the run's words, first window, number of windows).

    A window never leaves its text. Of equal smallest k-grams the rightmost is the anchor. The hash of a run also
    tells where in it the anchor is.
    """
    words = pack.words
    starts = len(words) - span + 1
    none = np.zeros(0, np.int64)
    if starts <= 0:
        return none.view(np.uint64), none.view(np.uint64), none, none
    grams = mixed(rolled(words, gram))
    choices = span - gram + 1  # k-grams in a window
    best, have = np.arange(len(grams)), 1
    while have < choices:
        step = min(have, choices - have)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(grams[b] <= grams[a], b, a)
        have += step
    best = best[:starts]
    at = np.arange(starts)
    last = np.repeat(pack.start[1:], np.diff(pack.start))[:starts]
    at = at[at + span <= last]
    if not len(at):
        return none.view(np.uint64), none.view(np.uint64), none, none
    anchor = best[at]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(new)
    begin, count = at[first], np.diff(np.concatenate((first, [len(at)])))
    # words begin .. begin + count + span - 1, from running sums of word * BASE ** place
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(len(words)))))
    run = (sums[begin + count + span - 1] - sums[begin]) * powers(len(words), UNBASE)[begin]
    run = mixed(run + np.uint64(BASE) * (anchor[first] - begin).astype(np.uint64) + count.astype(np.uint64))
    return grams[anchor[first]], run, begin, count


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pack in packs(batches):
        anchor, run, begin, count = winnow(pack)
        d = pack.owner(begin)
        docs = np.array([r[0] for r in pack.rows], np.int64)
        rows = np.array([r[1] for r in pack.rows], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), pa.array(docs[d]), pa.array(rows[d]),
             pa.array((begin - pack.start[d]).astype(np.int32)), pa.array(count.astype(np.int32))],
            ["anchor", "run", "doc", "row", "start", "windows"])


def _windows(sieve: Sieve):
    """Single windows of the runs that the sieve, over run hash and document, lets through: (anchor, run, doc, window, offset in the run)."""
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs(batches):
            anchor, run, begin, count = winnow(pack)
            docs = np.array([r[0] for r in pack.rows], np.int64)
            some = sieve.holds(run ^ docs[pack.owner(begin)].view(np.uint64)) if len(run) else np.zeros(0, bool)
            anchor, run, begin, count = anchor[some], run[some], begin[some], count[some]
            which = np.repeat(np.arange(len(run)), count)
            offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            window = mixed(rolled(pack.words, SPAN))[begin[which] + offset] if len(which) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[which].view(np.int64)), pa.array(run[which].view(np.int64)), pa.array(docs[pack.owner(begin[which])]),
                 pa.array(window.view(np.int64)), pa.array(offset.astype(np.int32))], ["anchor", "run", "doc", "window", "offset"])
    return expand


def keyed(docs: DataFrame) -> DataFrame:
    """doc (null last), row (hash of id and text) and text, whatever else ``docs`` has."""
    return docs.select(doc_key(F.col("doc_id")).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").alias("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, row, spans): maximal stretches of words that windows of smaller doc_ids cover, per document.

    ``spans``: array of (start, stop) in words, in order, disjoint. A window is SPAN consecutive words; it counts where
    a document with a smaller doc_id has the same words in a row. Documents without one are not listed. Rows
    with one doc_id have no order among themselves; null ids come last. Equality is that of two 64-bit hashes, of anchor and
    window (or run). No pairs are made: every comparison is with the smallest doc_id that has the same run or window, a
    minimum that is summed up map-side, so a passage in a third of all documents costs one row per occurrence.
    """
    texts = keyed(docs)
    runs = stored(texts.mapInArrow(_runs, RUN), "runs")
    # an anchor within one document leads nowhere; the sides of a join are stored, so that a hot key's partition can be split
    shared = stored(runs.groupBy("anchor").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("anchor"), "run-anchors")
    met = stored(runs.join(shared, "anchor"), "runs-met")
    kinds = stored(met.groupBy("anchor", "run").agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "run-kinds")
    whole = (met.join(kinds.where("first < last").select("anchor", "run", "first"), ["anchor", "run"]).where("doc > first")
             .select("doc", "row", "start", (F.col("start") + F.col("windows") + (SPAN - 1)).alias("stop")))
    # kinds of runs whose anchor has another kind too: their first documents are compared window by window
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    open_kinds = stored(kinds.join(several, "anchor", "left_semi").select("anchor", "run", "first"), "run-open")
    single = texts.select("doc", "row", "text").mapInArrow(_windows(Sieve(open_kinds.select(F.col("run").bitwiseXOR(F.col("first"))))), "anchor long, run long, doc long, window long, offset int")
    single = stored(single.join(open_kinds, ["anchor", "run"]).where("doc = first").drop("first"), "run-windows")
    # equal words around equal anchors make equal windows, wherever the runs begin
    first = stored(single.groupBy("anchor", "window").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                   .where("first < last").select("anchor", "window", "first"), "run-first")
    found = single.join(first, ["anchor", "window"]).where("doc > first").select("anchor", "run", F.col("doc").alias("d"), "offset").distinct()
    part = (met.join(found, (met["anchor"] == found["anchor"]) & (met["run"] == found["run"]) & (met["doc"] == found["d"]))
            .select("doc", "row", (F.col("start") + F.col("offset")).alias("start"), (F.col("start") + F.col("offset") + SPAN).alias("stop")))
    per_doc = whole.union(part).groupBy("doc", "row").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    joined = F.aggregate("spans", F.array().cast("array<struct<start:int,stop:int>>"), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(F.when(F.size(done) > 0, done["stop"]), -1) >= s["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop")))),
    ).otherwise(F.concat(done, F.array(s))))
    return per_doc.withColumn("spans", joined)


def cut(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    """The words outside the spans, which may overlap but come in order of their start."""
    kept, at = [], 0
    for s in spans or ():
        kept += words[at:s["start"]]
        at = max(at, s["stop"])
    return kept + words[at:]


def _cut(sieve: Sieve | None):
    """Rows (doc, row, text, spans) without the words in the spans; with a sieve only rows that it stops, whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if sieve is not None:
                rows = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                b = b.filter(pa.array(~sieve.holds(rows)))
            spans_of = b.column(3).to_pylist() if sieve is None else [None] * b.num_rows
            texts, n, removed = [], [], []
            for text, spans in zip(bytes_of(b.column(2)), spans_of, strict=True):
                words = split_words(text)
                kept = cut(words, spans)
                texts.append(b" ".join(kept))
                n.append(len(words))
                removed.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(texts, pa.binary()).cast(pa.string())], ["doc", "n_words", "n_removed", "kept"])
    return run


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_words, n_removed, kept (the words left, joined by one space).

    Every word that a window of a smaller doc_id covers goes, see ``repeats``. A null or empty text has no words and an
    empty rest; repeated rows stay, each with the same result; an empty table gives an empty one; further
    columns are ignored. Only texts that may lose words are shuffled to meet their spans: a sieve of fixed size over the
    documents that do tells which.
    """
    gone = stored(repeats(docs), "repeats")
    sieve = Sieve(gone.select("row"))
    texts = keyed(docs)
    schema = "doc long, n_words long, n_removed long, kept string"
    hit = texts.where(sieve.column(F.col("row"))).join(gone, ["doc", "row"], "left").select("doc", "row", "text", "spans")
    out = hit.mapInArrow(_cut(None), schema).union(texts.mapInArrow(_cut(sieve), schema))
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept")
