"""Word divergence against a plain version; perfect hashes."""
from collections import Counter, defaultdict

import numpy as np
import pytest

from kindred.llm import divergence
from tests.llm.brute import TERM


def plain(rows, least, ranks=10):
    """(lang, source, part, item, value, rank) of (lang, source, text) rows."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, tf, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(lower))
        groups[lang].add(source)
        df[lang].update(set(terms))
        tf[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        total = lambda counts: sum(counts[t] for t in kept)
        p = {}
        for s in sources:
            n = total(tf[lang, s])
            p[s] = {t: 1 + 10**9 * (tf[lang, s][t] + 2) // (n + 2 * len(kept)) for t in kept}
        whole = sum((tf[lang, s] for s in sources), Counter())
        n = total(whole)
        q = {t: 1 + 10**9 * (whole[t] + 2) // (n + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if tf[lang, s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, some in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize("least,shard,block", [(2, 1 << 15, 1 << 20), (2, 70, 1), (1, 70, 3000), (1000, 64, 1)])
def test_audit_equals_plain_version(spark, messy, least, shard, block):
    langs = [None, "", "en", "de"]
    rows = [(langs[(i or 0) % 4], s, t) for i, t, s in messy] + [("xx", "only", "Zeta"), ("yy", "a", None), ("yy", "b", "9 9")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, slot int, shard string").repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(df, least=least, shard=shard, block=block).collect())
    assert got == plain(rows, least)


def test_audit_of_nothing(none):
    assert divergence.audit(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5000])
def test_places_are_minimal_and_verified(n):
    terms = [b"t%d" % i for i in range(n)]
    seed, *packed = divergence.Shard.packed(terms)
    shard = divergence.Shard(seed, *packed)
    h = lambda some: np.array([divergence.xxh64_intdigest(t, divergence.SEED) for t in some], np.uint64)
    assert sorted(shard.slots(terms, h(terms)).tolist()) == list(range(n))
    assert [shard.words()[i] for i in shard.slots(terms, h(terms))] == terms
    strange = [b"s%d" % i for i in range(2000)]
    assert (shard.slots(strange, h(strange)) == -1).all()


def test_probabilities_are_exact_for_large_counts():
    n, total, v = np.array([0, 1, 10**14, 3 * 10**14 + 7]), 4 * 10**14 + 8, 4
    want = [1 + 10**9 * (int(x) + 2) // (total + 2 * v) for x in n]
    assert divergence.probability(n, total, v).tolist() == want
