import random

import pytest

from kindred.operators import candidates as ca
from kindred.operators import context, graph
from kindred.plans import resolve as rs

REC = "record_id string, given_name string, family_name string, event_year int, location string"
Q = "query_id bigint, given_name string, family_name string, approx_year int, location string, raw_query string"
PEOPLE = [("K1", "Ada", "Thornbury", 1861, "Leeds"), ("K2", "Ada", "Thornbury", 1864, "York"),
          ("K3", "Jon", "Marlow", 1870, "Leeds"), ("K4", "John", "Marlow", 1871, "Leeds"),
          ("K5", "Johnathan", "Marlow", 1866, "Leeds"), ("K6", "Ruth", "Quill", 1902, "Hull"),
          ("K7", "John", "Marlowe", 1885, "Leeds")]


def ids(df):
    return [r.record_id for r in df.orderBy("query_id", "rank").collect()]


def test_exact(spark):
    r = spark.createDataFrame(PEOPLE, REC)
    q = lambda *a: spark.createDataFrame([(1, *a, None)], Q)
    assert set(ids(ca.match_exact(q("John", "Marlow", 1871, "Leeds"), r))) == {"K3", "K4"}
    assert set(ids(ca.match_exact(q("Jon", "marlow", None, ""), r))) == {"K3", "K4"}
    assert ids(ca.match_exact(q("Ada", "Thornbury", 1866, None), r)) == ["K2"]
    own = {"ada": "ruth", "john": "johnathan"}
    assert ids(ca.match_exact(q("John", "Marlow", None, None), r, variants=own)) == ["K5", "K4"]


def test_search(spark):
    r = spark.createDataFrame(PEOPLE, REC)
    q = lambda *a: spark.createDataFrame([(1, *a, None)], Q)
    assert ids(ca.search_candidates(q("John", "Marlow", 1870, None), r)) == ["K4", "K5"]
    assert ids(ca.search_candidates(q(None, None, None, None), r)) == [
        "K1", "K2", "K5", "K3", "K4", "K7", "K6"]
    assert ids(ca.search_candidates(q("Ruth", "QUILL", None, "hul"), r)) == ["K6"]
    assert ids(ca.search_candidates(q("J%n", "Marl_w", 1870, None), r)) == []
    assert ids(ca.search_candidates(q("J%n", "Marl_w", 1870, None), r, wildcards=True)) == ["K5", "K3", "K4"]
    more = r.union(spark.createDataFrame([(f"X-{i:03}", "John", "Marlow", 1870, "Leeds") for i in range(25)], REC))
    assert len(ids(ca.search_candidates(q("John", "Marlow", 1870, None), more))) == 20


def test_blank_names_ask_for_any_but_match_exactly(spark):
    r = spark.createDataFrame([*PEOPLE, ("B1", "", "Marlow", 1870, None), ("B2", "John", "", 1870, None), ("B3", None, "Marlow", 1870, None)], REC)
    q = lambda *a: spark.createDataFrame([(1, *a, None)], Q)
    assert ids(ca.match_exact(q("John", "", None, None), r)) == ["B2"]
    assert ids(ca.search_candidates(q("", "Marlow", 1870, None), r)) == ["B1", "K5", "K3", "K4"]
    assert ids(ca.search_candidates(q("John", None, 1870, None), r)) == ["B2", "K4", "K5"]
    many = spark.createDataFrame([(i, "" if i % 2 else None, "", 1860 + i % 40, None, None) for i in range(3000)], Q)
    got = ca.search_candidates(many, r).groupBy("query_id").count()
    assert got.count() == sum(any(abs(y - 1860 - i % 40) <= 5 for y in (1861, 1864, 1870, 1871, 1866, 1902, 1885)) for i in range(3000))


def people(n, seed, hot):
    """A third of all rows share one name; years, places and some names are missing."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        g, f = rnd.choice(["John", "Jon", "Johnny", "Ann", "Joanna"]), rnd.choice(["Smith", "Smithson", "Lee", "Leed"])
        if i % 3 == 0 and hot:
            g, f = "John", "Smith"
        out.append((f"R{i:04}", g, f, rnd.choice([None, *range(1840, 1860)]),
                    rnd.choice([None, "", "Boston", "South Boston", "Rome"])))
    return out


def brute_search(qs, rs_, tol=5, limit=20):
    res = {}
    for qid, g, f, y, l, _ in qs:
        g, f = (g or "").lower(), (f or "").lower()
        hit = [r for r in rs_ if f in r[2].lower() and g in r[1].lower()
               and (y is None or (r[3] is not None and abs(r[3] - y) <= tol))
               and (l in (None, "") or (r[4] is not None and l.lower() in r[4].lower()))]
        hit.sort(key=lambda r: (r[2].lower() != f, r[1].lower() != g, r[3] is None, r[3] or 0, r[0]))
        if hit:
            res[qid] = [r[0] for r in hit[:limit]]
    return res


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.record_id)
    return out


def test_search_equals_brute_force_with_a_hot_name(spark):
    rows = people(600, 1, hot=True)
    rnd = random.Random(2)
    qs = [(i, rnd.choice(["John", "jo", "", None, "Ann"]), rnd.choice(["Smith", "s", "Lee", "", None]),
           rnd.choice([None, 1845, 1850]), rnd.choice([None, "", "boston", "o", "Rome"]), None) for i in range(120)]
    got = answers(ca.search_candidates(spark.createDataFrame(qs, Q), spark.createDataFrame(rows, REC)))
    assert got == brute_search(qs, rows)
    every = answers(ca.search_candidates(spark.createDataFrame(qs[:40], Q), spark.createDataFrame(rows, REC), limit=None))
    assert every == brute_search(qs[:40], rows, limit=10**9)


def test_pairs_equal_brute_force_with_a_hot_name(spark):
    rows = people(150, 3, hot=True)
    dated = sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[0]))
    want = {(a[0], b[0]) for i, a in enumerate(dated) for b in dated[i + 1:]
            if a[2].lower() == b[2].lower() and b[3] - a[3] <= 5}
    got = graph.candidate_pairs(spark.createDataFrame(rows, REC), 5).select("from_id", "to_id").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_year_band(spark, block):
    l = [(i, "ab"[i % 2], y) for i, y in enumerate([1840, 1845, -3, 0, 1999, None])]
    r = [(i, "ab"[i % 2], y) for i, y in enumerate([1838, 1843, 1850, -1, 2, 2004, None])]
    got = ca.year_band_join(spark.createDataFrame(l, "i int, k string, y int"),
                            spark.createDataFrame(r, "j int, k string, z int"), ["k"], "y", "z", 5, block)
    want = {(a[0], b[0]) for a in l for b in r if a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 5}
    assert sorted((x.i, x.j) for x in got.collect()) == sorted(want)


def test_snapshot(spark):
    rows = [("R-1", "John", "Smith", 1850, "Boston"), ("R-2", "John", "Smith", 1851, "Boston"),
            ("R-3", "Mary", "Jones", 1849, "boston, MA"), ("R-4", "Mary", "Jones", 1852, "Boston"),
            ("R-5", "William", "Brown", 1850, "Boston"), ("R-6", "William", "Brown", 1860, "Boston")]
    req = spark.createDataFrame([("a", "Boston", 1850), ("b", "Rome", 1850)], "request_id string, location string, year int")
    a, b = context.neighborhood_snapshot(req, spark.createDataFrame(rows, REC)).orderBy("request_id").collect()
    assert (a.record_count, a.year_range_min, a.year_range_max) == (5, 1849, 1852)
    assert a.common_names == ["John Smith", "Mary Jones", "William Brown"]
    assert (b.record_count, b.year_range_min, b.common_names) == (0, 1850, [])
    assert b.context_summary == "No records found near Rome around 1850."


def test_kept_counts_follow_changes(spark):
    """Three rounds of changed, new and removed records: kept counts equal counts made anew, and snapshots agree."""
    rnd, now = random.Random(8), {r[0]: r for r in people(60, 4, hot=True)}
    table = lambda rows: spark.createDataFrame(list(rows), REC)
    counts = context.place_counts(table(now.values()))
    for turn in range(3):
        new = {f"R{i:04}": (f"R{i:04}", *r[1:]) for i, r in zip(rnd.sample(range(90), 20), people(20, turn, hot=False), strict=True)}
        gone = [k for k in now if rnd.random() < 0.1 and k not in new]
        old = [now[k] for k in [*gone, *(k for k in new if k in now)]]
        counts = context.apply_changes(counts, context.count_changes(table(old), table(new.values())))
        now = {k: v for k, v in (now | new).items() if k not in gone}
    key = lambda df: sorted(map(str, df.select("l", "y", "name", "n").collect()))
    assert key(counts) == key(context.place_counts(table(now.values())))
    req = spark.createDataFrame([("a", "boston", 1850), ("b", "Rome", 1841)], "request_id string, location string, year int")
    assert sorted(map(str, context.neighborhood_snapshot(req, counts=counts).collect())) == sorted(
        map(str, context.neighborhood_snapshot(req, table(now.values())).collect()))


def test_resolve(spark):
    r = spark.createDataFrame([(*p, None) for p in PEOPLE], REC + ", birth_year int")
    q = spark.createDataFrame([(1, "John", "Marlow", 1870, "Leeds", None), (2, "Nobody", "Here", 1850, "Leeds", None),
                               (3, "John", "Marlow", None, None, None)], Q)
    e = spark.createDataFrame([("K5", [0.9, 0.1]), ("K4", [0.0, 1.0])], "record_id string, embedding array<float>")
    v = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, query_vector array<float>")
    one, two, three = rs.resolve(q, r, e, v).orderBy("query_id").collect()
    assert [c.record_id for c in one.ranked_candidates] == ["K5", "K4"]
    assert one.confidence_score == pytest.approx(0.95) and "hybrid_vector_rerank" in one.rules_triggered
    assert one.spatio_temporal_result.plausible and one.total_candidates == 7
    assert two.confidence_score == 0.15 and two.semantic_summary == "No candidates found."
    assert two.spatio_temporal_result is None and two.ranked_candidates == []
    assert three.spatio_temporal_result is None and len(three.ranked_candidates) == 3
    plain = rs.resolve(q, r).where("query_id = 1").first()
    assert [c.record_id for c in plain.ranked_candidates] == ["K4", "K5"]
    assert all(c.vector_similarity is None for c in plain.ranked_candidates)
    dated = rs.resolve(q, r.withColumn("birth_year", r.event_year + 10), use_birth_year=True).where("query_id = 1").first()
    assert "biological_plausibility" in dated.spatio_temporal_result.rules_triggered
    assert dated.confidence_score == pytest.approx(0.45)
