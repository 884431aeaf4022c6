import json

from pyspark.sql import functions as F

from kindred.plans import validate as va
from kindred.sources import landing as la

GOOD = {"recordId": "SYN-1", "givenName": "William", "familyName": "Harper", "eventYear": 1850, "location": "Boston"}


def line(**kw):
    d = {**GOOD, **kw}
    return json.dumps({k: v for k, v in d.items() if v is not ...})


CASES = [
    (line(), []),
    (line(familyName=...), ["missing required field: familyName"]),
    (line(recordId=None, eventYear=2099), ["null required field: recordId"]),
    (line(eventYear="1850", givenName=" william ", location="  Boston "), []),
    (line(eventYear="18x0"), ["wrong type for eventYear: expected int, got str"]),
    (line(eventYear=1850.5), ["wrong type for eventYear: expected int, got float"]),
    (line(eventYear=True), ["eventYear 1 out of range [1800–1950]"]),
    (line(eventYear=[1850], location={"a": 1}), ["wrong type for eventYear: expected int, got list",
                                                 "wrong type for location: expected str, got dict"]),
    (line(eventYear=2099), ["eventYear 2099 out of range [1800–1950]"]),
    (line(birthYear=1860), ["birthYear 1860 >= eventYear 1850"]),
    (line(birthYear="1700"), ["implied age 150 outside [1–110]"]),
    (line(birthYear="abc"), ["wrong type for birthYear: expected int, got str"]),
    (line(birthYear=1860.0), ["birthYear 1860.0 >= eventYear 1850"]),
    (line(birthYear=1700.5), ["implied age 149.5 outside [1–110]"]),
    (line(birthYear=1820.5), []),
    (line(note={"a": [1, "x"]}), []),
    (line(birthYear=None), []),
    (line(location="   "), ["location is empty after strip"]),
    ("[1, 2]", ["invalid JSON"]),
    ("William Harper, " + "x" * 300, ["invalid JSON"]),
    (line(rawContent="SSN 123-45-6789 a@b.org"), []),
]


def lines(spark, values, key="landing/a.ndjson"):
    return spark.createDataFrame([(key, i + 1, v) for i, v in enumerate(values)],
                                 "source_key string, source_line bigint, value string")


def test_rules_and_routing(spark):
    df = lines(spark, [c for c, _ in CASES])
    rows = va.checked_lines(df, "b").orderBy("source_line").collect()
    assert [r.reasons for r in rows] == [w for _, w in CASES]
    assert rows[3].givenName == "William" and rows[3].eventYear == 1850 and rows[3].location == "Boston"
    long = "William Harper, " + "x" * 300
    assert [r.raw for r in rows if r.value == long] == [long] and rows[0].raw is None
    assert [r.raw_preview for r in rows if r.value == long] == [long[:200]]
    bad = lines(spark, ["a,b", "c,d"], "landing/b.csv.ndjson")
    good, held = va.route(df.union(bad), "b1")
    good, held = good.collect(), held.orderBy("source_line").collect()
    # every line is in exactly one output; those of a file without JSON say so
    assert sorted((r.source_key, r.source_line) for r in good + held) == sorted(
        [("landing/a.ndjson", i + 1) for i in range(len(CASES))] + [("landing/b.csv.ndjson", 1), ("landing/b.csv.ndjson", 2)])
    assert {(r.source_key, r.file_reason) for r in held} == {("landing/a.ndjson", None), ("landing/b.csv.ndjson", "no valid JSON lines")}
    assert {r.batch_id for r in good} == {"b1"}
    assert {r.extra for r in good} == {None, '{"note":{"a":[1,"x"]}}', '{"birthYear":1820.5}'}
    assert {r.raw_content for r in good} == {None, "SSN [REDACTED] [REDACTED]"}


def test_manifest_and_replay(spark):
    df = lines(spark, [line(location=" "), "oops", line(eventYear=2099), line(location=" "), line()])
    held = va.route(df, "b1").quarantine
    m = va.quarantine_manifest(held, "2000-01-01")
    row = m.first()
    empty = spark.createDataFrame([("landing/none.ndjson",)], "source_key string")
    refused = va.route(lines(spark, ["a,b", "c" * 500]), "b1").quarantine
    both = {r.source_key: r for r in va.quarantine_manifest(refused, "2000-01-01", empty, "b1").collect()}
    assert both["landing/a.ndjson"].reasons == ["no valid JSON lines"] and both["landing/a.ndjson"].line_count == 2
    assert both["landing/none.ndjson"].reasons == ["empty file"] and both["landing/none.ndjson"].line_count == 0
    assert [r.value for r in va.replay_quarantine(refused).orderBy("source_line").collect()] == ["a,b", "c" * 500]
    text = held.withColumn("record", F.to_json("record"))
    assert sorted(map(str, va.replay_quarantine(text).collect())) == sorted(map(str, va.replay_quarantine(held).collect()))
    assert row.quarantine_key == "quarantine/a.ndjson" and row.line_count == 4 and row.replay_status == "pending"
    assert row.reasons == ["location is empty after strip", "invalid JSON", "eventYear 2099 out of range [1800–1950]"]
    again = va.replay_quarantine(held).orderBy("source_line").collect()
    assert json.loads(again[0].value) == {**GOOD, "location": " "} and again[1].value == "oops"
    results = spark.createDataFrame(
        [("quarantine/a.ndjson", "r1", 3, 1, [str(i) for i in range(30)]), ("quarantine/new", "r1", 2, 0, [])],
        "quarantine_key string, replay_batch_id string, ok bigint, failed bigint, errors array<string>")
    once = va.update_manifest(m, results, "2000-01-02")
    twice = {r.quarantine_key: r for r in va.update_manifest(
        once, results.where("ok = 3").withColumn("failed", F.lit(0)), "2000-01-03").collect()}
    a, new = twice["quarantine/a.ndjson"], twice["quarantine/new"]
    assert len(a.replays) == 2 and a.replay_status == "replayed" and len(a.replays[0].errors) == 10
    assert new.replay_status == "replayed" and len(new.replays) == 1


def test_manifest_has_every_reason(spark):
    """More distinct reasons than any bound of a group limit, in the order of their lines."""
    held = spark.range(3000).select(
        F.lit("landing/a.ndjson").alias("source_key"), (F.col("id") + 1).alias("source_line"), F.lit("b1").alias("batch_id"),
        F.array(F.concat(F.lit("reason "), (F.col("id") % 2500).cast("string"))).alias("reasons"), F.lit(None).cast("string").alias("file_reason"))
    row = va.quarantine_manifest(held.repartition(5), "2000-01-01").first()
    assert row.line_count == 3000 and row.reasons == [f"reason {i}" for i in range(2500)]
    assert va.quarantine_manifest(held, "2000-01-01", most=7).first().reasons == row.reasons[:7]


def test_outcomes(spark):
    got = va.ingest_summary(lines(spark, [line(), line(recordId=""), line(givenName=None), "x", line(familyName=...)]))
    r = got.first()
    assert (r.total, r.ok, r.skipped, r.failed, r.errors) == (5, 1, 3, 1, ["line 4: invalid JSON"])


def test_files_are_numbered_across_splits(spark, tmp_path):
    body = [f'{{"n":{i}}}' for i in range(3000)]
    (tmp_path / "archive").mkdir()
    (tmp_path / "big.ndjson").write_text("\n".join("\n" + b if i % 7 == 0 else b for i, b in enumerate(body)) + "\n")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "skip.csv").write_text("a,b\n")
    (tmp_path / "archive" / "old.ndjson").write_text("{}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        df = la.read_landing(spark, str(tmp_path))
        got = {r.source_line: r.value for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i + 1: b for i, b in enumerate(body)}
    files = {r.source_key.rsplit("/", 1)[1]: r.length for r in la.landing_files(spark, str(tmp_path)).collect()}
    assert set(files) == {"big.ndjson", "empty.json"} and files["empty.json"] == 0
    v = {r.source_key: r.file_reason for r in va.file_verdicts(
        df.withColumn("source_key", F.regexp_extract("source_key", "[^/]+$", 0)),
        spark.createDataFrame([("big.ndjson",), ("empty.json",)], "source_key string")).collect()}
    assert v == {"big.ndjson": None, "empty.json": "empty file"}


def test_chunks(spark):
    df = spark.createDataFrame([("raw/x/part.a.jsonl", i + 1, "{}") for i in range(450)] + [("noext", 1, "{}")],
                               "source_key string, source_line bigint, value string")
    got = {(r.chunk_key): r.n for r in la.assign_chunks(df, 200).groupBy("chunk_key").agg(F.count("*").alias("n")).collect()}
    assert got == {"raw/x/part.a-chunk-001.jsonl": 200, "raw/x/part.a-chunk-002.jsonl": 200,
                   "raw/x/part.a-chunk-003.jsonl": 50, "noext-chunk-001.ndjson": 1}
    assert la.oversize_files(df, 200).first().lines == 450


def test_only_empty_values_are_skipped(spark):
    values = [("0", "ok"), (0, "skipped"), ("false", "ok"), (False, "skipped"), ("", "skipped"), (None, "skipped"), ([], "skipped"), ({}, "skipped"),
              ("[]", "ok"), (0.0, "skipped"), (7, "ok"), (True, "ok"), ([1], "ok"), (..., "skipped")]
    got = va.ingest_outcomes(lines(spark, [line(recordId=v) for v, _ in values])).orderBy("source_line")
    assert [r.outcome for r in got.collect()] == [w for _, w in values]
    assert [r.source_line for r in va.ingest_errors(lines(spark, [line(), "x", "y"])).orderBy("source_line").collect()] == [2, 3]


def test_files_are_judged_by_the_parse_alone(spark):
    df = spark.createDataFrame([("a", 1, "{}"), ("a", 2, "x"), ("b", 1, "x")], "source_key string, source_line long, value string")
    steps = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Generate inline")
    quarantine = va.route(df, "b1").quarantine
    assert steps(quarantine) == steps(va.checked_lines(df, "b1")) > 0
    assert sorted((r.source_key, r.source_line, r.file_reason) for r in quarantine.collect()) == [
        ("a", 1, None), ("a", 2, None), ("b", 1, va.NO_JSON)]
