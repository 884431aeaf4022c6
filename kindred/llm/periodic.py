"""Runs of words that repeat with a period, found by minimizers of several scales.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, COPIES * q) words that no
neighbouring word extends. Periods up to DIRECT are found by comparing the words with themselves at every lag. Longer ones
are found by scale: a scale looks at the hashes of all grams of ``size`` words, takes the smallest in every window, and
proposes the distance of every two consecutive equal minima as a period. Inside a run of period q all windows
come again q words later, and so do their minima. A gram of q or more words does not occur again before that, as two
periods of a stretch so long have their common divisor as a period. So a scale finds every run with a period between
``least`` and ``size``, as long as two windows at distance q fit into COPIES * q words; ``scales`` sees to that.
Proposed places are extended both ways by prefix hashes, then every run is compared word for word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.words import BASE, bytes_of, mixed, powers, slices, split_words

LEAST, COPIES, DIRECT = 24, 3, 8
#: Words that are searched at once, about; texts are never cut.
PACK = 100_000


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(least, size, window) for the periods above DIRECT that a text of ``longest`` words can hold.

    A run has at least 3 * q - size + 1 whole grams, so windows of 2 * q - size + 1 grams fit into it twice, q words apart.
    """
    least = DIRECT + 1
    while COPIES * least <= longest:
        size = least * 3 // 2
        yield least, size, (COPIES - 1) * least - size + 1
        least = size + 1


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the first smallest value in each window of ``width`` values, each place once."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    at, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        have += step
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


class Prefixes:
    """Hashes of any stretch of a sequence of 64-bit numbers."""

    def __init__(self, words: np.ndarray):
        self.power = powers(len(words) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * self.power[:-1], dtype=np.uint64)))

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words at a hash like those at b, a before b."""
        return (self.sums[a + n] - self.sums[a]) * self.power[b - a] == self.sums[b + n] - self.sums[b]

    def grams(self, size: int) -> np.ndarray:
        """A hash per stretch of ``size`` words that does not depend on its place."""
        part = self.sums[size:] - self.sums[:len(self.sums) - size]
        return mixed(part * self.power[len(part) - 1::-1])


def reach(far: np.ndarray, good) -> np.ndarray:
    """For each i the largest n <= far[i] with good(n)[i]; good holds up to some n and not beyond."""
    low, high = np.zeros(len(far), np.int64), far.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        ok = good(mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return low


def direct(ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the longest stretches of period q (not the smallest perhaps) of enough words."""
    same = np.concatenate(([False], ids[q:] == ids[:max(len(ids) - q, 0)], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    start, stop = edges[::2], edges[1::2]
    enough = stop - start + q >= max(LEAST, COPIES * q)
    return start[enough], (stop - start + q)[enough]


def smallest(ids: np.ndarray, start: int, length: int, q: int) -> bool:
    """Whether a stretch with period q has no smaller one; that would divide q."""
    left, p = q, 2
    while left > 1:
        if p * p > left:
            p = left
        if left % p == 0:
            lag = q // p
            if (ids[start + lag:start + length] == ids[start:start + length - lag]).all():
                return False
            while left % p == 0:
                left //= p
        p += 1
    return True


def periodic(ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """All runs (start, length, period) of several texts behind one another.

    ``ids``: equal numbers for equal words; a number of its own follows each text. ``ends``: where the texts
    end, longest text first, so that a scale can leave the short ones out.
    """
    if not len(ends):
        return
    for q in range(1, DIRECT + 1):
        for s, n in zip(*(x.tolist() for x in direct(ids, q)), strict=True):
            if smallest(ids, s, n, q):
                yield s, n, q
    sizes = np.diff(np.concatenate(([-1], ends))) - 1
    spread = mixed((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
    whole = None
    for least, size, window in scales(int(sizes[0])):
        large = int(np.searchsorted(-sizes, -COPIES * least, "right"))
        n = int(ends[large - 1]) + 1
        if whole is None:
            whole = Prefixes(spread[:n])
        part = ids[:n]
        if n < size:
            return
        prefixes = whole if len(whole.power) == n + 1 else Prefixes(spread[:n])
        whole = prefixes
        hashes = prefixes.grams(size)
        at = window_minima(hashes, window)
        order = np.lexsort((at, hashes[at]))
        at = at[order]
        lag = at[1:] - at[:-1]
        pair = np.flatnonzero((hashes[at[1:]] == hashes[at[:-1]]) & (lag >= least) & (lag <= size))
        a, q = at[pair], lag[pair]
        if not len(a):
            continue
        back = reach(a, lambda k: prefixes.same(a - k, a - k + q, k))
        start = a - back
        ahead = reach(n - start - q, lambda k: prefixes.same(start, start + q, k))
        found = np.unique(np.stack((start, ahead + q, q), 1)[ahead >= (COPIES - 1) * q], axis=0)
        for s, length, period in found.tolist():
            same = part[s + period:s + length] == part[s:s + length - period]
            if same.all() and smallest(part, s, length, period):
                yield s, length, period


def pack_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words, by start and then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    known: dict[bytes, int] = {}
    ids, ends, n = [], [], 0
    for k, i in enumerate(order):
        own = np.fromiter((known.setdefault(w, len(known)) for w in texts[i]), np.int64, len(texts[i]))
        ids += [own, np.array([-1 - k])]
        n += len(own)
        ends.append(n)
        n += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    stops = np.array(ends, np.int64)
    for s, length, q in periodic(np.concatenate(ids) if ids else np.zeros(0, np.int64), stops):
        k = int(np.searchsorted(stops, s))
        out[order[k]].append((s - (ends[k - 1] + 1 if k else 0), length, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not runs:
        return words
    covered = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        covered[start + q] += 1
        covered[start + length] -= 1
    gone = np.cumsum(covered[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the largest length / period; of equal ones the first, then the shortest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, best struct<start: long, length: long, period: long>, runs_sha256 string, collapsed string"


def find(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Runs of every text of ``docs`` (text and the carried columns), one row per row.

    runs: all runs (word number, words, words of a period) by start, then period; best: the one with the most copies;
    runs_sha256: SHA-256 of the lines start,length,period; collapsed: the words outside later copies, joined by one
    space. Null and empty texts have no words, no runs and an empty ``collapsed``. Repeated rows stay repeated, an empty table gives an empty
    one, other columns are ignored. Rows are judged by themselves: one pass in place, no shuffle; a task holds
    the words of one text or about PACK words.
    """
    kept = [docs.schema[c] for c in carry]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + RESULT
    return docs.select(*carry, docs["text"].cast("string").alias("text")).mapInArrow(_finder(len(kept)), schema)


def _finder(n: int):
    spans = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def answer(held: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = pack_runs(texts)
        told = [hashlib.sha256("".join("%d,%d,%d\n" % r for r in some).encode()).hexdigest() for some in runs]
        named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in some] for some in runs]
        best = [x and dict(zip(("start", "length", "period"), x, strict=True)) for x in map(strongest, runs)]
        left = [b" ".join(collapse(w, r)).decode() for w, r in zip(texts, runs, strict=True)]
        return pa.RecordBatch.from_arrays(
            [*(held.column(i) for i in range(n)), pa.array([len(w) for w in texts], pa.int64()), pa.array(named, pa.list_(spans)),
             pa.array(best, spans), pa.array(told, pa.string()), pa.array(left, pa.string())],
            [*held.schema.names[:n], "n_words", "runs", "best", "runs_sha256", "collapsed"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            start, texts, size = 0, [], 0
            for i, text in enumerate(bytes_of(batch.column(n))):
                texts.append(split_words(text))
                size += len(texts[-1])
                if size >= PACK:
                    yield answer(batch.slice(start, i + 1 - start), texts)
                    start, texts, size = i + 1, [], 0
            if texts:
                yield answer(batch.slice(start), texts)

    return search
