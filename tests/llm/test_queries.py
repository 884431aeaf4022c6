"""The registered queries against their SQL or a plain version, over whole tables, and the pipeline."""
import hashlib

import pytest

import corpus_pipeline
from checks.compare import duck
from kindred.llm import decontaminate, lines, mixing, quality, simhash
from kindred.llm.oracle import ORACLE
from kindred.llm.queries import QUERIES, table
from tests.llm import brute
from tests.llm.conftest import SF


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(str(sorted(zip(names, r, strict=True))) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    got = sorted(str(sorted(r.asDict().items())) for r in QUERIES[name](spark, SF).collect())
    assert got == sql_rows(duck(SF), ORACLE[name])


def test_personal_data(spark):
    text = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for r in QUERIES["op2_contextual_pii"](spark, SF).collect():
        spans = brute.pii(text[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r["spans"].split(",")) or not joined


def test_simhash(spark):
    text = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    prints = {i: brute.simhash(t) for i, t in text.items()}
    want = brute.components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_bk_simhash"](spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in text}


def test_pipeline_equals_its_plain_version(spark):
    """Each stage redone in plain Python on what the one before kept; the mix by its totals."""
    rows = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    bench = [decontaminate.tokens((r["text"] or "").encode()) for r in table(spark, SF, "benchmark").collect()]
    judged = {r["doc_id"]: r[1] for r in quality.ledger(table(spark, SF, "documents")).select("doc_id", quality.kept("full-1")).collect()}
    texts = {i: r["text"] for i, r in rows.items() if judged[i]}
    assert all(not brute.quality(t)["base_failed"] for t in texts.values())
    texts = {i: kept for i, (_, gone, kept) in brute.line_dedup(list(texts.items()), lines.LEAST).items() if not gone or brute.words(kept)}
    group = brute.components({i: brute.simhash(t) for i, t in texts.items()}, simhash.RADIUS)
    texts = {i: t for i, t in texts.items() if group[i] == i}
    whole = {i: " ".join(decontaminate.tokens(t.encode())) for i, t in texts.items()}
    leaks = {i for i, t in whole.items() for b in bench if len(b) >= 13 and any(" ".join(b[j:j + 13]) in t for j in range(len(b) - 12))}
    texts = {i: t for i, t in texts.items() if i not in leaks}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts)
    sizes = {}
    for i, t in texts.items():
        assert got[i]["size"] == len(brute.words(t)) and got[i]["taken"] <= mixing.CAP * got[i]["size"]
        sizes[rows[i]["source"]] = sizes.get(rows[i]["source"], 0) + got[i]["size"]
    want = brute.targets(sizes)
    assert all(r["target"] == pytest.approx(want[r["source"]]) for r in got.values())


def test_stages_keep_columns_and_survive_messy_rows(spark, docs, none):
    some = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (some, none.select(*some.columns)):
        df = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in df.schema], name
            df = spark.createDataFrame(out.collect(), df.schema)
        corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()
    extra = docs.select("doc_id", "text", "lang", "source", "n_chars", "row", "key", "size", "fingerprint", "gone")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, SF).columns == extra.columns
