"""Language-model scores: counts against a plain version, probabilities that sum up to one, held-out texts."""
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import scoring
from kindred.llm.queries import QUERIES, table
from tests.llm import brute
from tests.llm.conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of (doc_id, text) rows."""
    split = lambda t: [*brute.words((t or "").translate(LOWER)), None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not out(i) for w in split(t))
    n, v = sum(count.values()), len(count)
    return sorted(((i, out(i), len(split(t)), sum(count[w] > 0 for w in split(t)), n,
                    round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in rows), key=str)


def rounded(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=str)


def test_query_counts_and_held_out_texts(spark):
    got = QUERIES["op13_neural_scores"](spark, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert rounded(got) == plain(rows)
    apart = got.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert apart[2] > 10 and 0 > apart[0] > apart[1]
    assert got.where("score >= 0 or isnan(score)").count() == 0


def test_messy_rows(spark, docs, messy, none):
    got = scoring.score(docs, symbols=64, classes=16, width=4, rounds=1, most=20)
    assert rounded(got) == plain([(i, t) for i, t, _ in messy])
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got.collect())
    assert scoring.score(none).count() == 0


def test_without_training_texts(docs, messy):
    got = scoring.score(docs, apart=F.lit(True), symbols=64, classes=16, width=4).collect()
    assert len(got) == len(messy)
    assert all((r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0) and r["score"] < 0 for r in got)


def small_lexicon(spark, symbols, classes, most):
    rows = [(f"w{i}", 1 + 500 // (i + 1)) for i in range(300)] + [("", 40)]
    return scoring.lexicon(spark.createDataFrame(rows, "token string, n long"), symbols, classes, most), rows


@pytest.mark.parametrize("symbols,most", [(40, 1000), (40, 60), (500, 1000)])
def test_lexicon_and_shares(spark, symbols, most):
    own, rows = small_lexicon(spark, symbols, 8, most)
    assert own.total == sum(n for _, n in rows) and own.types == 301 and own.ends == 40
    assert len(own.words) <= most and own.symbols == 1 + own.heads + 8
    count = dict(rows)
    for k in range(8):
        words = [w for w in count if w and own.symbol(w.encode()) == own.symbols - 8 + k]
        assert own.class_total[k] == sum(count[w] for w in words) and own.class_types[k] == len(words)
        assert sum((count[w] + 1) / (own.class_total[k] + own.class_types[k] + 1) for w in words) + 1 / (
            own.class_total[k] + own.class_types[k] + 1) == pytest.approx(1)


def trained(frequency, texts):
    task = scoring.Trainer(scoring.Model.fresh(frequency, 8), frequency, 0.3, 5)
    symbols, starts = np.concatenate(texts), np.cumsum([0, *map(len, texts[:-1])])
    for _ in range(20):
        task.learn(symbols, starts)
    return task.model


def test_probabilities_sum_up_to_one_and_learn_the_order():
    rng, n = np.random.default_rng(3), 30
    texts = [np.append((np.arange(60) * 7 + rng.integers(n)) % (n - 1) + 1, 0) for _ in range(200)]  # each word settles the next
    frequency = np.bincount(np.concatenate(texts), minlength=n) / 61 / 200
    model = trained(frequency, texts)
    log_z = model.log_z()
    first, second = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    p = np.stack([np.exp(model.scores(first, second, np.full(n * n, w)) - log_z[first, second]) for w in range(n)])
    assert p.sum(0) == pytest.approx(np.ones(n * n), abs=1e-4)
    a, b = scoring.contexts(texts[0], np.array([0]))
    own = model.scores(a, b, texts[0]) - log_z[a, b]
    assert own[1:].mean() > np.log(frequency[texts[0]]).mean() + 1


def test_contexts_stay_inside_texts():
    symbols, starts = np.array([5, 6, 7, 0, 0, 8, 0, 9, 0]), np.array([0, 4, 5, 7])
    first, second = scoring.contexts(symbols, starts)
    assert first.tolist() == [0, 5, 6, 7, 0, 0, 8, 0, 9]
    assert second.tolist() == [0, 0, 5, 6, 0, 0, 0, 0, 0]


@pytest.mark.parametrize("tasks", [1, 2])
def test_training_in_tasks(spark, tasks):
    """Two words that never meet, in one task or in two: one task learns it, the mean of two leans to it."""
    code = lambda *x: np.array(x, np.uint16).tobytes()
    rows = [(i, False, code(*[1 + i // 12000] * 3, 0)) for i in range(24000)]
    df = spark.createDataFrame(rows, "row long, held_out boolean, symbols binary").coalesce(tasks)
    model = scoring.train(df, np.array([0.25, 0.375, 0.374, 0.001]), width=4, rounds=3)
    log_z = model.log_z()
    p = lambda w, v: float(np.exp(model.scores(np.array([v]), np.array([v]), np.array([w]))[0] - log_z[v, v]))
    most = 0.05 if tasks == 1 else 0.3  # true: 0.5 and 0
    assert p(1, 1) > 0.3 and p(2, 2) > 0.3 and p(1, 2) < most and p(2, 1) < most
