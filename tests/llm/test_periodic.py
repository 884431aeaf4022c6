"""Periodic runs against a plain search of all periods."""
import hashlib
import random
import zlib

import pytest

from kindred.llm import periodic
from kindred.llm.queries import QUERIES, table
from tests.llm import brute
from tests.llm.conftest import SF


def runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(24, 3 * q) and not any(w[i + p:i + n] == w[i:i + n - p] for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts():
    rnd = random.Random(1)
    out = [[], ["a"], ["a"] * 500, ["a", "b"] * 300, ["x"] * 23, ["x"] * 24]
    for _ in range(250):
        k = rnd.choice([2, 3, 5, 50, 1000])
        w = [str(rnd.randrange(k)) for _ in range(rnd.randrange(300))]
        for _ in range(rnd.randrange(4)):
            base = [str(rnd.randrange(k)) for _ in range(rnd.randrange(1, 90))]
            at = rnd.randrange(len(w) + 1)
            w[at:at] = [base[i % len(base)] for i in range(rnd.randrange(24, 300))]
        out.append(w)
    a, b = ["a"], ["a", "b"]
    for _ in range(11):
        a, b = b, b + a  # Fibonacci words hold runs of many periods
    return [*out, b, ["t%d" % (i % 700) for i in range(2099)], ["t%d" % (i % 700) for i in range(2100)]]


def test_runs_equal_plain_search():
    words = texts()
    got = periodic.pack_runs([[x.encode() for x in w] for w in words])
    want = [runs(w) for w in words]
    assert got == want and sum(map(len, want)) > 200


def test_every_period_has_a_scale():
    for longest in (26, 27, 100, 20_000):
        all_of = [(low, size) for low, size, window in periodic.scales(longest) if window >= 1]
        covered = {q for low, size in all_of for q in range(low, size + 1)}
        assert covered >= set(range(periodic.DIRECT + 1, longest // 3 + 1))


def answer(w):
    found = runs(w)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], brute.sha("".join("%d,%d,%d\n" % r for r in found)),
            brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_query_equals_plain_search(spark):
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    text = {r["doc_id"]: brute.words(r["text"]) for r in table(spark, SF, "documents").collect()}
    small = {i: w for i, w in text.items() if len(w) <= 1500}
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in QUERIES["op12_minimizer_runs"](spark, SF).collect()}
    assert set(got) == set(text) and len(small) > 150
    assert {i: got[i] for i in small} == {i: answer(planted(i, w)) for i, w in small.items()}
    assert sum(got[i][0] for i in got) > 10


def test_messy_rows(docs, messy, none):
    got = periodic.find(docs, carry=("doc_id", "row")).collect()
    assert len(got) == len(messy)
    want = sorted((str(i), len(brute.words(t))) for i, t, _ in messy)
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in got) == want
    by = {i: t for i, t, _ in messy if i in (4, 15, 13)}
    for r in got:
        if r["doc_id"] in by:
            assert [tuple(x) for x in r["runs"]] == runs(brute.words(by[r["doc_id"]]))
        if r["n_words"] == 0:
            assert r["best"] is None and r["collapsed"] == "" and r["runs_sha256"] == hashlib.sha256(b"").hexdigest()
    assert periodic.find(none).count() == 0


@pytest.mark.parametrize("q,n", [(1, 24), (8, 24), (9, 27), (13, 39), (40, 120)])
def test_shortest_runs(q, n):
    w = [b"l", *(b"w%d" % (i % q) for i in range(n)), b"r"]
    assert periodic.pack_runs([w]) == [[(1, n, q)]]
    assert periodic.pack_runs([w[:n] + [b"r"]]) == [[]]


def test_packs_shorter_than_a_lag(spark):
    """A few words alone in a pack, as the last text behind a full one may be, have no runs."""
    for n in range(30):
        w = [b"a"] * n
        assert periodic.pack_runs([w]) == [runs(w)] and periodic.pack_runs([w, []]) == [runs(w), []]
    long = " ".join("t%d" % i for i in range(periodic.PACK))
    docs = spark.createDataFrame([(1, long), (2, "a b c d")], "doc_id long, text string").coalesce(1)
    assert [(r.doc_id, r.n_words, r.runs) for r in periodic.find(docs).collect()] == [(1, periodic.PACK, []), (2, 4, [])]
