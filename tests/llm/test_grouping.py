"""Operators that bring documents together: mixing, substrings, urls, SimHash, lines."""
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import lines, mixing, simhash, substrings, urls
from kindred.llm.components import components
from kindred.llm.stores import Sieve
from tests.llm import brute
from tests.llm.conftest import unique


def test_mix_meets_targets(docs, messy, none):
    got = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for _, t, s in messy:
        sizes[s] += len(brute.words(t))
    want = brute.targets(sizes)
    assert len(got) == len(messy)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    largest = {s: max(len(brute.words(t)) for _, t, x in messy if x == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)
    again = mixing.mix(docs.repartition(3)).collect()
    plain = lambda rows: sorted(str((r["doc_id"], r["size"], r["target"], r["copies"], round(r["rate"], 9))) for r in rows)
    assert plain(got) == plain(again)
    assert mixing.mix(none).count() == 0


def test_mix_of_many_documents_is_close(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.pmod(F.xxhash64("doc_id"), F.lit(60)) + 1), lambda x: F.lit("w")), " ")
    source = F.concat(F.lit("s"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 7))
    df = spark.range(6000).withColumnRenamed("id", "doc_id").select("doc_id", words.alias("text"), source.alias("source"))
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"),
                                               F.sum(F.col("rate") * F.col("size")).alias("expected")).collect()
    for r in got:
        assert r["expected"] == pytest.approx(r["target"], rel=1e-6) and abs(r["taken"] - r["target"]) <= 0.002 * r["target"] + 1


def test_many_equal_rows_are_dealt_to_many_cells(spark, monkeypatch):
    """Copies of one text without an id, a third of all rows: cells stay small, and reruns agree."""
    monkeypatch.setattr(mixing, "CELL", 50)
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d e f g").alias("text"), F.lit("s").alias("source"))
    other = spark.range(6000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 30).cast("int")), " ").alias("text"),
                                     F.concat(F.lit("s"), F.when(F.col("id") % 2 == 0, F.col("id") % 5)).alias("source"))
    df = same.union(other)
    got = mixing.mix(df)
    count = lambda x: sorted(str(tuple(r)) for r in x.groupBy("doc_id", "source", "copies", "taken").count().collect())
    assert got.count() == 9000 and count(got) == count(mixing.mix(df.repartition(7)))
    copies = {r["copies"]: r["count"] for r in got.where("doc_id IS NULL").groupBy("copies").count().collect()}
    assert sum(copies.values()) == 3000 and len(copies) <= 2


@pytest.mark.parametrize("sizes", [{"a": 0, "b": 0}, {"a": 10}, {"a": 1, "b": 100, None: 50, "é": 7, "z": 0}, {str(i): i * i for i in range(30)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r["source"]: r["target"] for r in mixing.targets(df).collect()} == pytest.approx(brute.targets(sizes))


def test_substrings_equal_plain_windows(docs, messy, none):
    want = brute.substring(list(unique(messy).items()))
    got = substrings.dedup(docs).collect()
    assert len(got) == len(messy)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]]
    assert sum(w[1] for w in want.values()) > 1000
    assert substrings.dedup(none).count() == 0


def test_substrings_where_runs_differ(spark):
    import random
    rnd = random.Random(1)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(60):  # overlapping cuts of one text between random words: many kinds of runs for each anchor
        a = rnd.randrange(240)
        cut = base[a:a + rnd.randrange(30, 120)]
        if i % 3 == 0:
            cut[rnd.randrange(len(cut))] = f"x{i}"
        rows.append((i, " ".join([f"l{i}_{j}" for j in range(rnd.randrange(60))] + cut + [f"r{i}_{j}" for j in range(rnd.randrange(60))])))
    rows += [(100, "z " * 200), (101, "z " * 120), (None, rows[0][1])]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.substring(rows)


def test_fingerprints_and_components(docs, messy, none, spark):
    texts = unique(messy)
    prints = {i: brute.simhash(t) for i, t in texts.items()}
    want = brute.components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(messy)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"] % 2**64, r["component_id"]) == (prints[r["doc_id"]], want[r["doc_id"]])
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {1}
    assert simhash.near_duplicates(none).count() == 0
    alone = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["component_id"]) for r in alone] == [(None, None)]


@pytest.mark.parametrize("tree", [7, 4096])
def test_trees_lose_no_link(spark, tree):
    rnd = np.random.default_rng(5)
    some = rnd.integers(0, 2**64, 60, dtype=np.uint64)
    prints = set(some.tolist())
    for x in some.tolist():  # clusters and chains, also across the blocks' borders
        for _ in range(8):
            for b in rnd.choice(64, rnd.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    hot = int(some[0]) & ~0xFFF
    prints |= {hot | int(i) for i in rnd.choice(4096, 250, replace=False)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fingerprint long")
    edges = simhash.links(df, tree=tree)
    found = {r["node"] % 2**64: r["component"] % 2**64 for r in components(edges).collect()}
    want = brute.components({p: p for p in prints})
    classes = lambda d: sorted(sorted(g) for g in _groups(d).values())
    assert classes({p: found.get(p, p) for p in prints}) == classes(want)


def _groups(labels):
    out = {}
    for k, v in labels.items():
        out.setdefault(v, []).append(k)
    return out


def test_components_of_chains_stars_and_noise(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(150)] + [(5, 5), (None, 3), (7, None), (2001, 2000), (2000, 2001)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(150)} | {2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_line_dedup_equals_plain_edits(docs, messy, none):
    want = brute.line_dedup(list(unique(messy).items()))
    got = lines.dedup(docs, carry=["key", "lang"]).collect()
    assert len(got) == len(messy)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_lines"], r["n_removed"], r["kept"]) == want[r["doc_id"]], r["doc_id"]
        assert r["key"] == "k" and r["lang"] is None
    assert [want[i][1] for i in range(20, 26)] == [0, 1, 1, 1, 1, 0]
    assert lines.dedup(none).count() == 0


def test_half_keys_meet_whatever_the_edit():
    line = [b"w%d" % i for i in range(12)]
    for i in range(12):
        for other in (line[:i] + [b"x"] + line[i + 1:], line[:i] + line[i + 1:], line[:i] + [b"x"] + line[i:], [*line, b"x"]):
            assert set(lines.half_keys(line)) & set(lines.half_keys(other))
            assert set(lines.variants(line).tolist()) & set(lines.variants(other).tolist())
            assert lines.within_one_edit(line, other) and lines.within_one_edit(other, line)
    assert not lines.within_one_edit(line, [b"x", *line[2:]]) and not lines.within_one_edit(line, [b"x", b"y", *line[2:]])


def test_sieve_holds_all_members(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS k")
    sieve = Sieve(keys.union(spark.sql("SELECT CAST(NULL AS BIGINT)")), bits=1 << 16)
    assert keys.where(sieve.column(F.col("k"))).count() == 5000
    others = spark.range(10_000, 20_000).selectExpr("xxhash64(id) AS k")
    assert others.where(sieve.column(F.col("k"))).count() < 1200
    assert Sieve(keys.where("k = 0"), bits=1 << 15).holds(np.arange(10, dtype=np.uint64)).sum() == 0


URLS = [("http://A.example.org/es/1", "example.org/es/", "block"), ("http://www.example.org/en/123?q", "example.org/en/1", "block"), ("http://q.org/x", "org/", "allow"),
        ("http://org/x", "org/", "allow"), ("http://xorg/x", None, "allow"), ("https://a.com/fr/", "com/fr/", "allow"), ("https://a.com/de/9#x", "com/de/", "block"),
        ("https://a.com?/de/", None, "allow"), ("nothing", None, "allow"), (None, None, "allow"), ("x://", None, "allow"), ("http://q.org", None, "allow")]


def _page(*links):
    return "<html><head><meta charset='utf-8'>" + "".join(links) + "</head>"


def test_dot_segments_and_ports_are_one_address(spark):
    rows = [("http://H.x/a/b/../c", "http://h.x/a/c"), ("http://h.x/a/./b/.", "http://h.x/a/b/"), ("http://h.x/../../a", "http://h.x/a"),
            ("http://h.x", "http://h.x/"), ("http://h.x/..", "http://h.x/"), ("https://h.x:443/a?q=/../b#f", "https://h.x/a?q=/../b"),
            ("http://h.x:443/a", "http://h.x:443/a"), ("http://h.x:80", "http://h.x/"), ("http://h.x/a..b/...", "http://h.x/a..b/..."), ("http://h.x/a//b/../c", "http://h.x/a//c")]
    got = spark.createDataFrame(rows, "url string, want string").select(urls.address(F.col("url")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_relative_links_lead_to_their_pages(spark):
    """A block reaches pages through links with dots, ports and no path."""
    link = lambda to: f'<link rel="canonical" href="{to}">'
    pages = [(1, "http://free.com/x/y/page", link("../../z/./end")), (2, "http://free.com/z/end", link("http://bad.com:80/de/a")),
             (3, "http://free.com/q/r?s", link("./../up")), (4, "http://free.com/up", link("//bad.com/de/x/..")), (5, "http://free.com/up/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_rules_of_urls(spark):
    pages = [(i, u, None) for i, (u, _, _) in enumerate(URLS)] + [(0, URLS[0][0], "x")]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("node", F.lit("n"))).collect()
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in got if r["page_id"]) == sorted((i, rule, v) for i, (_, rule, v) in enumerate(URLS) if i)
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    assert (by[0]["host"], by[0]["path"], by[7]["host"], by[7]["path"], by[8]["host"], by[9]["path"]) == ("a.example.org", "/es/1", "a.com", "", "", "")


def test_aliases_inherit_blocks_and_allowances(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    refresh = '<META http-equiv=refresh content="0; URL=\'{}\'">'.format
    pages = [(1, "http://a.net/1", _page(canonical("http://a.com/de/x"))),  # blocked target
             (2, "http://b.net/2", _page(refresh("http://a.net/1#frag"))),  # alias of an alias
             (3, "http://c.net/3", _page(canonical("http://a.com/de/y"), canonical("http://ok.org/z"))),  # an allowed alias wins
             (4, "http://a.com/de/y", None),  # its own rule stays
             (5, "http://d.net/5", _page('<link href="/6" rel="next canonical">')), (6, "http://d.net/6", _page(canonical("//a.com/de/w"))),
             (7, "http://e.net/7", _page(canonical(""), canonical("mailto:x"), '<link rel="stylesheet" href="http://a.com/de/x">')), (8, None, _page(canonical("http://a.com/de/x")))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow"}
    moved = df.where("page_id = 7").withColumn("redirect", F.lit("http://a.com/de/q"))
    assert [r["verdict"] for r in urls.judge(moved).collect()] == ["block"]
    assert urls.judge(df.where("page_id = 99")).count() == 0
