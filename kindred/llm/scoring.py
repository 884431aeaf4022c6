"""A log-bilinear language model of words, trained by noise-contrastive estimation in numpy, with normalised scores.

The model speaks SYMBOLS symbols: the end of a text, the most frequent words, and CLASSES classes of all other words, by
their last bytes. The score of symbol w after u and v is s = (first[v] + second[u]) . out[w] + bias[w], where vectors have
WIDTH numbers; a text starts after two ends. The probability of a word is exp(s) / Z(u, v), for a word of a class times (c + 1) / (N + V + 1),
where c is its count in the training texts, N and V the tokens and types of its class; the last share is that of words never seen.
So all probabilities after a context sum up to one.

Training: all training texts are gone through once, in ROUNDS parts. For each part every task takes the current model, goes through its texts
by noise-contrastive estimation (Z is taken to be one there, words are told apart from words drawn by frequency), and gives its changed rows;
rows are averaged, weighted by the examples that touched them. Z comes afterwards from matrix products: exp(s) is a product of a part per
context word, so Z of all pairs of context words is one product of two tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kindred.llm.stores import stored
from kindred.llm.words import bytes_of, slices

SYMBOLS, CLASSES, WIDTH = 2048, 256, 32
ROUNDS, BATCH, NOISE, RATE, START = 2, 512, 48, 0.3, 30.0
#: Words whose counts every task holds; those of the others are joined.
LEXICON = 200_000
#: Tokens that a task trains on in mixed order; distinct words that it counts at once.
CHUNK, HELD = 200_000, 400_000
END = b""


def split(text: bytes | None) -> list[bytes]:
    """Words in lower case; ``bytes.lower`` changes A-Z only."""
    return text.lower().split() if text else []


def class_of(word: bytes, classes: int) -> int:
    return xxh64_intdigest(word[-2:]) % classes


@dataclass
class Lexicon:
    """What the tasks know of words. Symbol 0 is the end, then come the frequent words, then the classes."""

    words: dict[bytes, int]  # word -> place in the arrays below, by count descending
    counts: np.ndarray
    heads: int  # so many of them (the first) are symbols of their own
    symbols: int
    classes: int
    total: int  # N of the base score
    types: int  # V of the base score
    ends: int
    class_total: np.ndarray | None = None
    class_types: np.ndarray | None = None

    def symbol(self, word: bytes) -> int:
        place = self.words.get(word, self.heads)
        return 1 + place if place < self.heads else self.symbols - self.classes + class_of(word, self.classes)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, base log10 probability and log10 share of its class, per place."""
        symbol = np.arange(1, len(self.words) + 1)
        symbol[self.heads:] = [self.symbol(w) for w in islice(self.words, self.heads, None)]
        base = np.log10(self.counts + 1.0) - self.base_room()
        share = np.zeros(len(symbol))
        rare = slice(self.heads, None)
        share[rare] = np.log10(self.counts[rare] + 1.0) - self.share_room()[symbol[rare] - (self.symbols - self.classes)]
        return symbol, base, share

    def base_room(self) -> float:
        return float(np.log10(self.total + self.types + 1.0))

    def share_room(self) -> np.ndarray:
        return np.log10(self.class_total + self.class_types + 1.0)

    def frequency(self) -> np.ndarray:
        """Probability of each symbol by count, none zero."""
        n = np.ones(self.symbols)
        n[0] += self.ends
        n[1:1 + self.heads] += self.counts[:self.heads]
        n[self.symbols - self.classes:] += self.class_total
        return n / n.sum()


@dataclass
class Model:
    """Tables of vectors: the first and second word before, and the word itself with its bias as last column; ``speed`` per table and row."""

    first: np.ndarray
    second: np.ndarray
    out: np.ndarray
    speed: np.ndarray

    @classmethod
    def fresh(cls, frequency: np.ndarray, width: int) -> Model:
        """Scores are the log frequencies, up to small random numbers."""
        n, rng = len(frequency), np.random.default_rng(42)
        first, second, out = (rng.normal(0, 0.1, (n, width)).astype(np.float32) for _ in range(3))
        return cls(first, second, np.concatenate((out, np.log(frequency)[:, None].astype(np.float32)), 1), np.full((3, n), START, np.float32))

    def tables(self) -> tuple[np.ndarray, ...]:
        return self.first, self.second, self.out

    def log_z(self) -> np.ndarray:
        """log Z of every pair (word before, the one before that), from products of matrices."""
        width = self.first.shape[1]
        a, b = self.first @ self.out[:, :width].T + self.out[:, width], self.second @ self.out[:, :width].T
        high_a, high_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        a -= high_a
        b -= high_b
        z = np.exp(a, out=a) @ np.exp(b, out=b).T
        return np.log(z, out=z) + high_a + high_b.T

    def scores(self, first: np.ndarray, second: np.ndarray, word: np.ndarray) -> np.ndarray:
        width = self.first.shape[1]
        own = self.out[word]
        return np.einsum("ij,ij->i", self.first[first] + self.second[second], own[:, :width]) + own[:, width]


def contexts(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each; a text, ``starts`` says where, begins after two ends."""
    first, second = np.zeros_like(symbols), np.zeros_like(symbols)
    first[1:], second[2:] = symbols[:-1], symbols[:-2]
    first[starts] = second[starts] = 0
    second[starts[starts + 1 < len(symbols)] + 1] = 0
    return first, second


class Trainer:
    """A task's copy of the model, on its way."""

    def __init__(self, model: Model, frequency: np.ndarray, rate: float, seed: int):
        self.model = Model(*(x.copy() for x in (*model.tables(), model.speed)))
        self.touched = np.zeros(model.speed.shape, np.int64)
        self.rng, self.rate = np.random.default_rng(seed), rate
        self.upto, self.noise = np.cumsum(frequency), (np.log(NOISE) + np.log(frequency)).astype(np.float32)

    def _move(self, k: int, rows: np.ndarray, change: np.ndarray) -> None:
        """A step of rows (of table k) against their summed gradients, smaller the more they moved before."""
        order = rows.astype(np.uint16).argsort(kind="stable")
        rows = rows[order]
        at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        which, total = rows[at], np.add.reduceat(change[order], at, axis=0)
        self.touched[k, which] += np.diff(at, append=len(rows))
        speed = self.model.speed[k, which] + np.einsum("ij,ij->i", total, total) / total.shape[1]
        self.model.speed[k, which] = speed
        self.model.tables()[k][which] -= (self.rate / np.sqrt(speed))[:, None] * total

    def learn(self, symbols: np.ndarray, starts: np.ndarray) -> None:
        """Once through some texts, in random order."""
        first, second = contexts(symbols, starts)
        order = self.rng.permutation(len(symbols))
        m, width = self.model, self.model.first.shape[1]
        for i in range(0, len(order), BATCH):
            at = order[i:i + BATCH]
            a, b, w = first[at], second[at], symbols[at]
            z = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), len(self.upto) - 1)
            q = np.concatenate((m.first[a] + m.second[b], np.ones((len(at), 1), np.float32)), 1)
            own, drawn = m.out[w], m.out[z]
            real = -1 / (1 + np.exp(np.einsum("ij,ij->i", q, own) - self.noise[w]))
            false = 1 / (1 + np.exp(self.noise[z] - q @ drawn.T))
            back = (real[:, None] * own + false @ drawn)[:, :width]
            self._move(0, a, back)
            self._move(1, b, back)
            self._move(2, np.concatenate((w, z)), np.concatenate((real[:, None] * q, false.T @ q)))


def train_rows(encoded: DataFrame, turn: int, rounds: int) -> DataFrame:
    """The symbols of the training texts of one part."""
    return encoded.where(~F.col("held_out") & (F.col("row") % rounds == turn)).select("symbols")


def _batched(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of some texts behind one another, about ``size``, and where texts start."""
    held: list[np.ndarray] = []
    for b in slices(batches):
        held += [np.frombuffer(x, np.uint16) for x in b.column(0).to_pylist()]
        if sum(map(len, held)) >= size:
            yield np.concatenate(held).astype(np.int64), np.cumsum([0, *map(len, held[:-1])])
            held = []
    if held:
        yield np.concatenate(held).astype(np.int64), np.cumsum([0, *map(len, held[:-1])])


def _learner(shared, turn: int, width: int):
    names = ["k", "row", "touched", "speed", *(f"x{i}" for i in range(width + 1))]

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequency = shared.value
        task = None
        for symbols, starts in _batched(batches, CHUNK):
            task = task or Trainer(model, frequency, RATE / (turn + 1), 1000 * TaskContext.get().partitionId() + turn)
            task.learn(symbols, starts)
        for k, table in enumerate(task.model.tables() if task else []):
            row = np.flatnonzero(task.touched[k])
            x = table[row].astype(np.float64)
            x = np.pad(x, ((0, 0), (0, width + 1 - x.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), pa.array(row.astype(np.int32)), pa.array(task.touched[k, row]),
                                              pa.array(task.model.speed[k, row].astype(np.float64)), *map(pa.array, x.T)], names)

    return learn


def train(encoded: DataFrame, frequency: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> Model:
    """The model after all training texts, in ``rounds`` parts. The driver sees the averaged rows, of the model's size."""
    sc = encoded.sparkSession.sparkContext
    model = Model.fresh(frequency, width)
    columns = [f"x{i}" for i in range(width + 1)]
    schema = "k int, row int, touched long, speed double, " + ", ".join(f"{c} double" for c in columns)
    for turn in range(rounds):
        shared = sc.broadcast((model, frequency))  # of the model's size
        rows = train_rows(encoded, turn, rounds).mapInArrow(_learner(shared, turn, width), schema)
        mean = [(F.sum(F.col(c) * F.col("touched")) / F.sum("touched")).alias(c) for c in ("speed", *columns)]
        got = rows.groupBy("k", "row").agg(*mean).toArrow()
        model = Model(*(x.copy() for x in (*model.tables(), model.speed)))
        k, row = got.column("k").to_numpy(), got.column("row").to_numpy()
        x = np.stack([got.column(c).to_numpy() for c in columns], 1) if len(k) else np.zeros((0, width + 1))
        for i, table in enumerate(model.tables()):
            table[row[k == i]] = x[k == i, :table.shape[1]]
        model.speed[k, row] = got.column("speed").to_numpy()
        shared.unpersist()
    return model


def _token_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "n"])

    for b in slices(batches):
        for text in bytes_of(b.column(0)):
            held.update(split(text))
            held[END] += 1
        if len(held) >= HELD:
            yield out()
            held = Counter()
    yield out()


def lexicon(counts: DataFrame, symbols: int = SYMBOLS, classes: int = CLASSES, most: int = LEXICON) -> Lexicon:
    """``counts`` (token, n): the lexicon of at most ``most`` words, cut where a class of counts (an eighth of an octave) ends."""
    spark = counts.sparkSession
    octave = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(octave.alias("step")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("n")).orderBy(F.col("step").desc()).collect()  # at most 8 x 63 rows
    total, types, known, lowest = sum(r["n"] for r in steps), sum(r["types"] for r in steps), 0, 10**6
    for r in steps:
        known += r["types"]
        if known > most + 1:
            break
        lowest = r["step"]
    some = counts.where((octave >= lowest) & (F.col("token") != "")).collect()  # at most ``most`` words
    some = sorted(((-r["n"], r["token"].encode()) for r in some))
    ends = counts.where("token = ''").agg(F.sum("n")).first()[0] or 0
    heads = min(len(some), symbols - 1 - classes)
    own = Lexicon({w: i for i, (_, w) in enumerate(some)}, np.array([-n for n, _ in some], np.int64), heads, 1 + heads + classes, classes, total, types, ends)
    shared = spark.sparkContext.broadcast(own)

    def class_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, v = shared.value, np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for b in batches:
            for word, count in zip(bytes_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                if word and words.words.get(word, words.heads) >= words.heads:
                    k = class_of(word, classes)
                    n[k] += count
                    v[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes, dtype=np.int32)), pa.array(n), pa.array(v)], ["k", "n", "v"])

    own.class_total, own.class_types = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for r in counts.select("token", "n").mapInArrow(class_counts, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        own.class_total[r["k"]], own.class_types[r["k"]] = r["n"], r["v"]
    return own


ENCODED = "row long, n_tokens long, n_known long, base double, share double, symbols binary, rest array<struct<token: string, n: long>>"


def _encoder(shared, n: int):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Lexicon = shared.value[0]
        symbol, base, share = shared.value[1]
        low, room, rooms = own.symbols - own.classes, own.base_room(), own.share_room()
        end_base = float(np.log10(own.ends + 1.0)) - room
        row = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            facts: list[tuple] = []
            rest: list[Counter] = []
            for text in bytes_of(b.column(n)):
                words = split(text)
                place = np.fromiter(map(own.words.get, words, repeat(-1)), np.int64, len(words))
                codes = np.zeros(len(words) + 1, np.uint16)
                known = place >= 0
                inside, outside = place[known], np.flatnonzero(~known).tolist()
                codes[:-1][known] = symbol[inside]
                one, two = float(base[inside].sum()) + end_base - room * len(outside), float(share[inside].sum())
                rest.append(Counter([words[i] for i in outside]))
                if outside:
                    k = [class_of(words[i], own.classes) for i in outside]
                    codes[outside] = np.add(k, low)
                    two -= float(rooms[k].sum())
                facts.append((row, len(words) + 1, len(inside) + (own.ends > 0), one, two, codes.tobytes()))
                row += 1
            columns = list(zip(*facts, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            tokens = pa.array([w for some in rest for w in some], pa.binary()).cast(pa.string())
            pairs = pa.StructArray.from_arrays([tokens, pa.array([c for some in rest for c in some.values()], pa.int64())], ["token", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rest)]), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)), lists],
                                             [*b.schema.names[:n], "row", "n_tokens", "n_known", "base", "share", "symbols", "rest"])

    return encode


def _scorer(shared, n: int):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_z = shared.value
        for b in slices(batches):
            if not b.num_rows:
                continue
            codes = [np.frombuffer(x, np.uint16) for x in b.column(n).to_pylist()]
            symbols, starts = np.concatenate(codes).astype(np.int64), np.cumsum([0, *map(len, codes[:-1])])
            first, second = contexts(symbols, starts)
            log_p = np.concatenate([model.scores(first[i:j], second[i:j], symbols[i:j]).astype(np.float64) - log_z[first[i:j], second[i:j]]
                                    for i, j in ((i, i + CHUNK) for i in range(0, len(symbols), CHUNK))])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(np.add.reduceat(log_p, starts) / np.log(10))], [*b.schema.names[:n], "model"])

    return score


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: one in seven, by the CRC of its id; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, apart: Column | None = None, symbols: int = SYMBOLS, classes: int = CLASSES, width: int = WIDTH,
          rounds: int = ROUNDS, most: int = LEXICON) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score, score (double): one row per row.

    The model learns from all rows outside ``apart`` (the default is ``held_out`` of doc_id) and scores all: log10
    probabilities of the whole text with its end. base_score is that of single tokens by count, one added; n_known counts the tokens that occur in
    training. A null or empty text is its end alone. Without training texts every word falls to its class. Repeated rows count and stay as often as
    they come; an empty table gives an empty one; other columns are ignored.

    Texts are read twice (counts, symbols); training and scores read the stored symbols, two bytes a token. Tasks hold the model and
    the counts of ``most`` words; those of rarer words are joined, per document and word. The driver holds the same, whatever the number of texts.
    """
    spark = docs.sparkSession
    apart = held_out(F.col("doc_id")) if apart is None else apart
    read = docs.select("doc_id", apart.alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = stored(read.where(~F.col("held_out")).select("text").mapInArrow(_token_counts, "token string, n long")
                    .groupBy("token").agg(F.sum("n").alias("n")), "lm-counts")
    own = lexicon(counts, symbols, classes, most)
    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = stored(read.mapInArrow(_encoder(spark.sparkContext.broadcast((own, own.tables())), 2), f"doc_id {kind}, held_out boolean, {ENCODED}"), "lm-symbols")
    model = train(encoded, own.frequency(), width, rounds)
    shared = spark.sparkContext.broadcast((model, model.log_z()))  # of the model's size
    facts = ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "share"]
    schema = f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, share double, model double"
    scored = encoded.select(*facts, "symbols").mapInArrow(_scorer(shared, len(facts)), schema)
    rest = encoded.select("row", F.inline("rest")).join(counts.withColumnRenamed("n", "c"), "token", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rest_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rest_known"))
    some = scored.join(rest, "row", "left")
    more = F.coalesce("rest_log", F.lit(0.0))
    return some.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
                       F.lit(own.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
                       (F.col("model") + F.col("share") + more).alias("score"))
