"""Personal data: fixed formats first, then identifiers found by the company they keep.

The formats' matches are the seeds. The words around a seed form lexical patterns with a slot. A second reading
takes whatever fills the slot of such a pattern, one to four words; a pattern is as good as the share of seeds among all
that it meets, and a filler as good as its patterns. Scores go back and forth over the pattern-instance
graph, a few rounds, as Spark joins and sums. Fillers of high score that look like an identifier become spans of their own, and what
stands around them, where they were found, forms further patterns.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kindred.llm.stores import Sieve, stored
from kindred.llm.words import BASE, Pack, mixed, packs, slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORDS = re.compile("[^\\x20\\x09-\\x0D]+")
#: Context words are compared with A-Z lower-cased, digits as 0 and without outer punctuation.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz" + b"0" * 9)
_OUTER = b".,;:!?\"'()[]{}<>#*$%&|"
_EMPTY = np.uint64(xxh64_intdigest(b""))
#: A slot holds one to this many words.
SLOT = 4
#: Digits that an identifier has at least, if it has no inner @ or underscore.
DIGITS = 4
#: Trust that a pattern needs. Texts are read for prose by one in so many, then the next, at last all.
CONFIDENCE, SHARES = 0.8, (64, 8, 1)

SCAN = ("key long, base array<struct<kind:int,start:int,stop:int>>, "
        "seen array<struct<kind:int,instance:string,patterns:array<long>>>")
HITS = "pattern long, filler long, key long, start int, stop int, instance string, around array<long>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, anchored at the @ so that a long word is read once."""
    free = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            free = m.end()
            yield start, free


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each four numbers of a dotted run in turn; what is left over is none."""
    for m in _DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            stop = start + len(".".join(four))
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, stop
            start = stop + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


FINDERS = (emails, ips, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the fixed formats, by kind and then start."""
    return [(k, a, b) for k, find in enumerate(FINDERS) for a, b in find(text)]


def folded(text: bytes) -> list[bytes]:
    """Context words of a text."""
    return [w.strip(_OUTER) for w in text.translate(_FOLD).split()]


def marked(word: bytes) -> bool:
    """Whether a word may be part of an identifier: it has a digit, an @ or an underscore."""
    return b"0" in word or b"@" in word or b"_" in word


def shaped(words: list[bytes]) -> bool:
    """Whether folded words look like an identifier: each may be part of one, and together they have DIGITS digits or an inner @ or _."""
    joined = b" ".join(words)
    return all(map(marked, words)) and (joined.count(b"0") >= DIGITS or any(x in w[1:-1] for w in words for x in (b"@", b"_")))


def _left(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed((a * np.uint64(3) + b) * np.uint64(BASE) + np.uint64(1))


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed((a * np.uint64(5) + b) * np.uint64(BASE) + np.uint64(2))


def _right(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed((a * np.uint64(7) + b) * np.uint64(BASE) + np.uint64(3))


def around(words: np.ndarray, i: int, j: int) -> list[int]:
    """Patterns around the words i to j - 1 of a text's word hashes: two before, one on either side, two after."""
    ok, keys = words != _EMPTY, []
    if i >= 2 and ok[i - 2:i].all():
        keys.append(_left(words[i - 2:i - 1], words[i - 1:i]))
    if i >= 1 and j < len(words) and ok[i - 1] and ok[j]:
        keys.append(_both(words[i - 1:i], words[j:j + 1]))
    if j + 1 < len(words) and ok[j:j + 2].all():
        keys.append(_right(words[j:j + 1], words[j + 1:j + 2]))
    return np.concatenate(keys).view(np.int64).tolist() if keys else []


def seeds(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """kind, instance and patterns of the base spans of a text; a span's slot are the words that it touches."""
    at = [m.span() for m in _WORDS.finditer(text)]
    starts, stops = [a for a, _ in at], [b for _, b in at]
    words, hashed, found = folded(text.encode()), {}, []
    for kind, a, b in spans:
        i, j = bisect_right(starts, a) - 1, bisect_left(stops, b) + 1
        first = max(0, i - 2)
        near = range(first, min(len(at), j + 2))
        hashed.update((k, xxh64_intdigest(words[k])) for k in near if k not in hashed)
        hashes = np.array([hashed[k] for k in near], np.uint64)
        found.append({"kind": kind, "instance": text[a:b], "patterns": around(hashes, i - first, j - first)})
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, doc_id) -> key, base, seen, doc_id."""
    span = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "stop")]))
    seen_type = pa.list_(pa.struct([("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.int64()))]))
    for batch in slices(batches):
        base, seen = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text) if text else []
            base.append([{"kind": k, "start": a, "stop": b} for k, a, b in spans])
            seen.append(seeds(text, spans) if spans else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(seen, seen_type), batch.column(2)],
                                         ["key", "base", "seen", "doc_id"])


def _slots(sieve: Sieve, identifiers: bool = True):
    """(key, text, copy) -> HITS: what fills the slots of patterns that the sieve lets through.

    With ``identifiers`` the slots whose word beside the context is ``marked``, else all others. Prose fillers come once
    per pattern and pack, without text and place; a filler that may be an identifier comes with both.
    A slot that touches a base span is that seed's and is left out.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = []

        def split(text: bytes) -> list[bytes]:
            words = folded(text)
            flags.append(np.fromiter(map(marked, words), bool, len(words)))
            return words

        for pack in packs((b.append_column("copy", b.column(1)) for b in batches), split=split):
            mine = np.concatenate(flags) == identifiers
            flags.clear()
            yield from _fill(pack, sieve, mine, identifiers)
    return read


def _fill(pack: Pack, sieve: Sieve, mine: np.ndarray, identifiers: bool) -> Iterator[pa.RecordBatch]:
    """Hits of the slots that begin (those open to the left: end) at words of ``mine``."""
    h, n = pack.words, len(pack.words)
    at = np.flatnonzero(mine)
    own = pack.owner(at)
    lo, hi, ok = pack.start[own], pack.start[own + 1], np.concatenate((h != _EMPTY, np.zeros(SLOT + 1, bool)))
    kept = []  # (pattern, word, words in the slot; 0: open to the right, -1: open to the left)

    def hit(i: np.ndarray, keys, size: int) -> None:
        pattern = keys(i)
        some = np.flatnonzero(sieve.holds(pattern))
        kept.append((pattern[some], i[some], size))

    hit(at[(at >= lo + 2) & ok[at - 1] & ok[at - 2]], lambda i: _left(h[i - 2], h[i - 1]), 0)
    hit(at[(at + 2 < hi) & ok[at + 1] & ok[at + 2]], lambda i: _right(h[i + 1], h[i + 2]), -1)
    for size in range(1, SLOT + 1):
        hit(at[(at > lo) & (at + size < hi) & ok[at - 1] & ok[at + size]], lambda i, size=size: _both(h[i - 1], h[i + size]), size)
    if not any(len(p) for p, _, _ in kept):
        return
    texts, prose, rows = _Texts(pack), [], []
    for pattern, i, size in kept:
        filler = h[i]
        for k in range(1, size):
            filler = mixed(filler * np.uint64(BASE) + h[i + k])
        for k, doc in enumerate(pack.owner(i)) if identifiers else ():
            found = texts.identifier(int(doc), int(i[k] - pack.start[doc]), size)
            if found == "seed":
                filler[k] = 0
            elif found:
                start, stop, keys = found
                rows.append((int(pattern[k].view(np.int64)), pack.rows[doc][0], start, stop, texts.text(doc)[start:stop], keys))
                filler[k] = 0
        some = filler != 0
        prose.append(np.unique(np.stack((pattern[some], filler[some])), axis=1))
    prose = np.concatenate(prose, axis=1).view(np.int64)
    m, none = prose.shape[1], len(rows)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((prose[0], np.array([r[0] for r in rows], np.int64)))),
         pa.concat_arrays([pa.array(prose[1]), pa.nulls(none, pa.int64())]),
         *[pa.concat_arrays([pa.nulls(m, t), pa.array([r[c] for r in rows], t)])
           for c, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.string()), (5, pa.list_(pa.int64())))]],
        ["pattern", "filler", "key", "start", "stop", "instance", "around"])


class _Texts:
    """The texts of a pack, worked out where a slot is hit."""

    def __init__(self, pack: Pack):
        self.pack, self.done = pack, {}

    def text(self, doc: int) -> str:
        return self.pack.rows[doc][1]

    def identifier(self, doc: int, i: int, size: int) -> tuple[int, int, list[int]] | str | None:
        """(start, stop, patterns around) of the longest identifier in a slot; "seed" where a base span touches it, None if there is none."""
        if doc not in self.done:
            text = self.text(doc)
            at = [m.span() for m in _WORDS.finditer(text)]
            spans = sorted((a, b) for _, a, b in base_spans(text))
            # spans of different kinds may overlap: up to each, the furthest end
            self.done[doc] = at, folded(text.encode()), [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
        at, words, starts, ends = self.done[doc]
        hashes = self.pack.words[self.pack.start[doc]:self.pack.start[doc + 1]]
        ways = [(i, i + size)] if size > 0 else [(i, i + k) if size == 0 else (i - k + 1, i + 1) for k in range(SLOT, 0, -1)]
        text = self.text(doc)
        for a, b in ways:
            if a < 0 or b > len(words):
                continue
            start, stop = at[a][0], at[b - 1][1]
            while start < stop and not text[start].isalnum() and not (text[start] in "(+" and stop - start > 1):
                start += 1
            while stop > start and not text[stop - 1].isalnum():
                stop -= 1
            before = bisect_left(starts, stop)
            if before and ends[before - 1] > start:
                if size > 0 or b - a == 1:
                    return "seed"
            elif shaped(words[a:b]):
                return start, stop, around(hashes, a, b)
        return None


def learn(edges: DataFrame, prose: DataFrame, rounds: int = 3, support: int = 3, confidence: float = CONFIDENCE, certain: float = 0.9) -> DataFrame:
    """(instance, kind) of strings that patterns identify.

    ``edges``: pattern, instance, kind, one row per pattern and instance; ``kind`` is -1 for strings without a known format.
    ``prose``: pattern, n: how many distinct other fillers a pattern meets. Per round, a pattern's score for a kind is the
    mean score of the distinct fillers it meets; it counts from ``confidence`` on, with
    at least ``support`` instances of the kind. An instance's score is 1 minus the product of
    its patterns' (1 - score); it is taken from ``certain`` on, with two patterns or more, for its best kind.
    Patterns and instances are only ever summed up, never gathered, and sums are decimal, so that reruns agree.
    """
    exact = "decimal(28,9)"
    known = edges.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    met = (edges.select("pattern", F.lit(1).cast("long").alias("n")).union(prose.select("pattern", "n"))
           .groupBy("pattern").agg(F.sum("n").alias("met")))
    open_edges = edges.where("kind < 0").select("pattern", "instance")
    scored = stored(known, "pii-scores")
    for _ in range(rounds):
        votes = (edges.select("pattern", "instance").join(scored, "instance").groupBy("pattern", "kind")
                 .agg(F.sum(F.col("score").cast(exact)).cast("double").alias("votes"), F.sum(F.when(F.col("score") >= 0.5, 1).otherwise(0)).alias("n")))
        good = (votes.where(F.col("n") >= support).join(met, "pattern")
                .select("pattern", "kind", (F.col("votes") / F.col("met")).alias("trust")).where(F.col("trust") >= confidence))
        doubt = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9))).cast(exact)).cast("double")
        found = (open_edges.join(good, "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"), F.count(F.lit(1)).alias("n"))
                 .where((F.col("n") >= 2) & (F.col("score") >= certain)))
        best = found.groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"))).alias("b"))
        scored = stored(known.union(best.select("instance", -F.col("b.col2"), "b.score")), "pii-scores")
    return scored.join(open_edges.select("instance").distinct(), "instance").select("instance", "kind")


def prose_met(texts: DataFrame, patterns: DataFrame, confidence: float) -> DataFrame:
    """(pattern, n): how many distinct prose fillers patterns meet in ``texts`` (key, text), as far as it matters.

    ``patterns``: pattern, instances, beside (what it meets anyway). An instance has at most two scores a kind, of at most 1, so a pattern's
    trust is at most 2 instances / (all it meets). Texts are read in growing shares; a pattern whose trust cannot reach ``confidence`` after
    what a share showed is done, with the count so far, which rules it out as well as the whole count would. All others are
    counted over all texts.
    """
    hopeless = 2 * F.col("instances") / (F.col("instances") + F.col("beside") + F.col("n")) < confidence
    left, counts = stored(patterns.withColumn("n", F.lit(0)).where(~hopeless).drop("n"), "pii-open"), None
    for share in SHARES:
        if left.isEmpty():
            break
        some = texts.where(F.pmod(F.col("key"), F.lit(share)) == 0) if share > 1 else texts
        counted = stored(some.mapInArrow(_slots(Sieve(left.select("pattern")), False), HITS).join(left, "pattern")
                         .groupBy("pattern", "instances", "beside").agg(F.countDistinct("filler").alias("n")), "pii-prose")
        done = (counted.where(hopeless) if share > 1 else counted).select("pattern", "n")
        counts = done if counts is None else counts.union(done)
        left = stored(left.join(done, "pattern", "left_anti"), "pii-open")
    return texts.sparkSession.createDataFrame([], "pattern long, n long") if counts is None else counts


def find(docs: DataFrame, text: str = "text", turns: int = 2, support: int = 3, **settings) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, base, learned: arrays of (kind, start, stop) in order.

    Offsets are code points, ``stop`` is exclusive; ``kind`` indexes KINDS. ``learned`` spans overlap neither
    base ones nor each other (the first by start stays, of these the longest). Patterns need ``support`` distinct seeds; what identifies strings in one turn
    gives the patterns of the next. A null or empty text has no span; repeated rows get the same ones
    each; an empty table gives an empty one; further columns are ignored. Texts are read
    once for the formats and once or twice per turn with new patterns, and not shuffled: what follows works on the fillers of slots.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.xxhash64("doc_id", text).alias("key"), F.col(text).alias("text"), "doc_id")
    scanned = stored(rows.mapInArrow(_scan, f"{SCAN}, doc_id {kind.simpleString()}"), "pii-scan")
    known = scanned.select(F.explode("seen").alias("x")).select("x.kind", "x.instance", F.explode("x.patterns").alias("pattern"))
    known = stored(known.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-seeds")
    texts = rows.select("key", "text").where("text IS NOT NULL")
    some = texts.where(F.col("text").rlike("[0-9@_]"))  # others have no marked word
    met, searched, counted, learned, hits, prose = known.select("pattern", "instance"), None, None, None, None, None
    more = lambda old, new: new if old is None else old.union(new)
    for _ in range(turns):
        fresh = met.distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("pattern")
        fresh = stored(fresh if searched is None else fresh.join(searched, "pattern", "left_anti"), "pii-patterns")
        if fresh.isEmpty():
            break
        searched = more(searched, fresh)
        hits = more(hits, stored(some.mapInArrow(_slots(Sieve(fresh)), HITS).join(fresh, "pattern", "left_semi"), "pii-hits"))
        # a string needs two patterns, so only patterns of such strings have to be weighed
        unknown = hits.where("instance IS NOT NULL").select("pattern", "instance").distinct().join(known.select("instance").distinct(), "instance", "left_anti")
        twice = unknown.groupBy("instance").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("instance")
        weighed = stored(unknown.join(twice, "instance", "left_semi").select("pattern").distinct(), "pii-weighed")
        new = weighed if counted is None else stored(weighed.join(counted, "pattern", "left_anti"), "pii-new")
        counted = more(counted, new)
        beside = hits.where("filler IS NOT NULL").join(weighed, "pattern", "left_semi").groupBy("pattern").agg(F.countDistinct("filler").alias("n"))
        edges = (known.select("pattern", "instance", "kind").union(hits.where("instance IS NOT NULL").select("pattern", "instance", F.lit(-1)))
                 .join(weighed, "pattern", "left_semi").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
        edges = stored(edges, "pii-edges")
        if not new.isEmpty():
            sizes = edges.join(new, "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
            sizes = sizes.join(beside, "pattern", "left").select("pattern", "instances", F.coalesce("n", F.lit(0)).alias("beside"))
            prose = more(prose, prose_met(texts, sizes, settings.get("confidence", CONFIDENCE)))
        if prose is None:
            break
        learned = stored(learn(edges, prose.union(beside), support=support, **settings), "pii-learned")
        places = hits.where("instance IS NOT NULL").join(learned, "instance")
        met = known.select("pattern", "instance").union(places.select(F.explode("around"), "instance"))
    none = F.array().cast("array<struct<kind:int,start:int,stop:int>>")
    if learned is None:
        return scanned.select("doc_id", "base", none.alias("learned"))
    # by start, of equal starts the longest first; what overlaps a span that stayed goes
    place = F.struct("start", (-F.col("stop")).alias("end"), "kind")
    spans = F.aggregate(F.array_sort(F.collect_set(place)), none, lambda kept, x: F.when(
        (F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1))["stop"] <= x["start"]),
        F.concat(kept, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["end"]).alias("stop"))))).otherwise(kept))
    per_text = places.groupBy("key").agg(spans.alias("learned"))
    return scanned.join(per_text, "key", "left").select("doc_id", "base", F.coalesce("learned", none).alias("learned"))
