import json
import shutil
import time

from pyspark.sql import functions as F

from checks import testbed
from kindred.operators.embed import HashingEmbedder
from kindred.plans import validate
from kindred.schemas import RECORDS
from kindred.sources import bucketed
from kindred.streaming import alarms, gaps, ingest

AT = "2000-01-01 00:00:00"
EV = "ts string, ingress int, quarantined int, errors int, gap_count int, latency_ms double, batch_id int"


def finish(writer, checkpoint):
    q = writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()


def events(spark, tmp_path):
    rows = [(f"2000-01-01 00:{m:02}:30", 1, q, q > 40, g, 100.0 * m, m)
            for m, q, g in [(1, 30, 1), (3, 30, 0), (6, 50, 0), (16, 1, 2), (31, 0, 0), (46, 0, 1), (59, 0, 1)]]
    df = spark.createDataFrame([(*r[:3], int(r[3]), *r[4:]) for r in rows], EV).withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_table_stream_reads_a_file_or_a_folder(spark, tmp_path):
    spark.range(20).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for part in (tmp_path / "events.parquet").glob("part-*"):
        shutil.copy(part, tmp_path / "documents.parquet")
    for name in ("events", "documents"):
        want = sorted(r.id for r in spark.read.parquet(f"{tmp_path}/{name}.parquet").collect())
        out = testbed.table_stream(spark, str(tmp_path), name).writeStream.format("parquet").option("path", str(tmp_path / name))
        finish(out, tmp_path / f"{name}-checkpoint")
        assert want and sorted(r.id for r in spark.read.parquet(str(tmp_path / name)).collect()) == want


def test_alarms_batch_and_stream_agree(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    minute = lambda df, c: sorted(r[0].minute + 60 * (r[0].hour) for r in df.select(c).collect())
    assert minute(alarms.quarantine_spike(batch), "window_start") == [0]          # 60 > 50; exactly 50 is not
    assert minute(alarms.error_alarm(batch), "window_start") == [5]
    assert minute(alarms.gap_alarm(batch), "window_end") == [30]                  # 00 and 15; 45 alone is no run
    three = alarms.gap_alarm(batch.withColumn("gap_count", F.lit(1)), periods=3)
    assert minute(three, "window_end") == [45, 60]
    assert alarms.latency_percentiles(batch, "1 hour").first().p50 == 1600.0
    for name, fn in {"spike": alarms.quarantine_spike, "rate": alarms.stream_ingest_rate, "ingress": alarms.ingress_counts,
                     "gap": alarms.gap_alarm, "latency": alarms.latency_percentiles, "errors": alarms.error_alarm}.items():
        out = str(tmp_path / name)
        finish(fn(stream).writeStream.outputMode("update").foreachBatch(
            lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{i}")), tmp_path / f"{name}-c")
        first = spark.read.schema(fn(batch).schema).parquet(f"{out}/0")  # all files are one batch
        assert sorted(first.collect()) == sorted(fn(batch).collect()), name


def append(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_gap_runs_over_restarts_equal_batch(spark, tmp_path):
    """Three tables; files in several starts, one of them late within the watermark, one behind it."""
    schema, path = "monitor string, ts string, gap_count int", str(tmp_path / "in")
    at = lambda m: f"2000-01-01 {m // 60:02}:{m % 60:02}:10"
    first = [("a", at(m), 1) for m in (1, 16, 31, 33, 46)] + [("b", at(1), 1), ("b", at(16), 0), ("b", at(31), 2), ("b", at(46), 1), (None, at(2), 1)]
    second = [("a", at(m), 1) for m in (61, 91)] + [("b", at(61), None), ("b", at(66), 5), ("b", at(58), 0), ("c", at(62), 1), (None, at(17), 1)]
    third = [("a", at(106), 1), ("c", at(76), 1), ("c", at(91), 1), ("a", at(121), 0), ("b", at(121), 0)]
    late, end = [("a", at(76), 1)], [("z", "2000-01-03 00:00:00", 0)]
    name, store = gaps.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        for part in (first, second, third, end, late, [("z", "2000-01-05 00:00:00", 0)]):
            append(spark, path, part, schema)
            stream = spark.readStream.schema("monitor string, ts timestamp, gap_count int").parquet(path)
            finish(gaps.gap_runs(stream, periods=2, lateness="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "c")
    finally:
        spark.conf.set(name, before)
    got = spark.read.parquet(str(tmp_path / "out"))
    seen = spark.createDataFrame(first + second + third + end, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    want = gaps.gap_runs(seen, periods=2)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    runs = {(r.monitor, r.window_end.hour * 60 + r.window_end.minute): r.length for r in want.collect()}
    assert runs == {("a", 30): 2, ("a", 45): 3, ("a", 60): 4, ("a", 75): 5, ("a", 120): 2, ("b", 60): 2, ("b", 75): 3,
                    ("c", 90): 2, ("c", 105): 3, (None, 30): 2}
    assert gaps.gap_runs(seen, periods=70).count() == 0


def test_replay_through_a_new_checkpoint_adds_nothing(spark, tmp_path):
    schema, out = "k string, n int, ts string", str(tmp_path / "out")
    append(spark, str(tmp_path / "in"), [("a", 1, "2000-01-01 00:00:00"), (None, 2, "2000-01-01 00:00:00"), ("a", 1, "2000-01-01 00:00:00")], schema)
    files = spark.readStream.schema("k string, n int, ts timestamp").parquet(str(tmp_path / "in"))

    def run(name):
        finish(ingest.stream_first_arrivals(files, ["k", "n"], out, name, buckets=3), tmp_path / name)
        return sorted((r.k or "", r.n) for r in spark.read.parquet(f"{out}/rows").collect())

    assert run("one") == [("", 2), ("a", 1)]
    append(spark, str(tmp_path / "in"), [("b", 1, "2000-03-01 00:00:00"), ("a", 1, "2000-03-01 00:00:00"), ("a", 3, "2000-03-01 00:00:00")], schema)
    assert run("one") == [("", 2), ("a", 1), ("a", 3), ("b", 1)]
    assert run("replay") == [("", 2), ("a", 1), ("a", 3), ("b", 1)]  # all files once more, weeks later
    assert spark.read.parquet(f"{out}/seen").count() == 4


def test_a_batch_that_was_cut_off_comes_out_whole(spark, tmp_path):
    """Its keys were noted, its rows were not written: the second try writes them."""
    out = str(tmp_path / "out")
    append(spark, str(tmp_path / "in"), [("a", 1, "2000-01-01 00:00:00"), ("b", 2, "2000-01-01 00:00:00")], "k string, n int, ts string")
    bucketed.create_buckets(spark.createDataFrame([('{"k":"a"}', "one", 0)], "key string, run string, epoch long"), f"{out}/seen", "key", 4)
    stream = spark.readStream.schema("k string, n int, ts timestamp").parquet(str(tmp_path / "in"))
    finish(ingest.stream_first_arrivals(stream, ["k"], out, "one"), tmp_path / "c")
    assert sorted(r.k for r in spark.read.parquet(f"{out}/rows").collect()) == ["a", "b"]
    assert bucketed.bucket_count(spark, f"{out}/seen") == 4


def test_meter_counts_a_stream_as_it_runs(spark, tmp_path):
    lines = spark.createDataFrame([("f", 1, '{"recordId":"R1","givenName":"a","familyName":"b","eventYear":1850,"location":"x"}'), ("f", 2, "no"), ("g", 1, "[]")],
                                  "source_key string, source_line long, value string")
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    meter = validate.ValidationMeter()
    spark.streams.addListener(meter)
    try:
        checked = validate.metered(validate.checked_lines(stream, "b")).select("source_key", "source_line", "reasons")
        finish(checked.writeStream.queryName("lines").format("parquet").option("path", str(tmp_path / "out")), tmp_path / "c")
        for _ in range(50):
            if meter.totals:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(meter)
    assert meter.totals["lines"] == {"ingress": 3, "validated": 1, "quarantined": 2}
    want = validate.validation_summary(lines).agg(F.sum("ingress"), F.sum("validated"), F.sum("quarantined")).first()
    assert tuple(want) == (3, 1, 2)


def test_sketches_merge_to_longer_windows(spark):
    df = spark.range(20_000).select(F.timestamp_seconds(946684800 + F.col("id") * 5).alias("ts"), ((F.col("id") * 7919) % 20_011).cast("double").alias("latency_ms"))
    parts = alarms.latency_sketches(df.unionByName(df.limit(3).withColumn("latency_ms", F.lit(None).cast("double"))))
    for window, windows in (("1 hour", 28), ("1 day", 2)):
        merged = alarms.sketch_percentiles(alarms.merge_sketches(parts, window)).collect()
        assert len(merged) == windows and sum(r.n for r in merged) == 20_000
        exact = {r.w: sorted(r.v) for r in df.groupBy(F.window("ts", window)["start"].alias("w")).agg(F.collect_list("latency_ms").alias("v")).collect()}
        for r in merged:
            v = exact[r.window_start]
            for q, value in ((0.5, r.p50), (0.99, r.p99)):
                assert abs(sum(x <= value for x in v) / len(v) - q) <= 0.0165 + 1 / len(v)


def test_buckets_grow_and_times_move(spark, tmp_path):
    table, bigger = str(tmp_path / "t"), str(tmp_path / "t2")
    rows = lambda *a: spark.createDataFrame(a, "record_id string, given_name string, arrival int").select(
        "record_id", "given_name", F.lit("F").alias("family_name"), F.lit(None).cast("int").alias("event_year"), F.lit(None).cast("int").alias("birth_year"),
        F.lit(None).cast("string").alias("location"), F.lit("s").alias("source"), "arrival")
    stream = lambda: spark.readStream.schema(rows(("x", "x", 1)).schema).parquet(str(tmp_path / "in"))
    none = spark.createDataFrame([], RECORDS)
    rows(*[(f"R{i}", "one", 1) for i in range(50)]).write.mode("append").parquet(str(tmp_path / "in"))
    finish(ingest.stream_upsert(stream(), table, none, buckets=4), tmp_path / "c")
    rows(("R1", "two", 2)).write.mode("append").parquet(str(tmp_path / "in"))
    finish(ingest.stream_upsert(stream(), table, none, buckets=99), tmp_path / "c")
    got = {r.record_id: r for r in bucketed.read_buckets(spark, table, RECORDS).collect()}
    assert len(got) == 50 and got["R1"].given_name == "two" and got["R1"].updated_at > got["R2"].updated_at
    assert bucketed.bucket_count(spark, table) == 4 and bucketed.rebucket(spark, table, bigger, RECORDS, "record_id") == 8
    more = bucketed.read_buckets(spark, bigger, RECORDS)
    assert more.select("bucket").distinct().count() == 8 and more.count() == 50
    assert more.where(F.col("bucket") != bucketed.bucket_of("record_id", 8)).count() == 0


def test_dedupe(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    out = str(tmp_path / "out")
    finish(ingest.dedupe_arrivals(stream.unionByName(stream), ["batch_id"]).writeStream.format("parquet")
           .option("path", out), tmp_path / "c")
    assert spark.read.parquet(out).count() == 7
    assert ingest.dedupe_arrivals(batch.unionByName(batch), ["batch_id"]).count() == 7


def test_files_to_records(spark, tmp_path):
    good = lambda i, **kw: json.dumps({"recordId": f"R{i}", "givenName": "ann", "familyName": "lee", "eventYear": 1850,
                                       "location": "Boston", **kw})
    src = tmp_path / "landing"
    src.mkdir()
    (src / "a.ndjson").write_text("\n".join([good(1), "", "oops", good(2, eventYear=2099)]) + "\n")
    out = str(tmp_path / "out")

    def run():
        finish(ingest.stream_validate(ingest.stream_landing(spark, str(src)), out, AT), tmp_path / "c")

    run()
    (src / "b.json").write_text(good(3) + "\n" + good(1, givenName="bea") + "\n")
    (src / "c.txt").write_text(good(9) + "\n")
    run()
    run()                                                      # nothing new: nothing happens
    v = spark.read.parquet(f"{out}/validated")
    assert sorted((r.record_id, r.source_line, r.batch_id) for r in v.collect()) == [
        ("R1", 1, "epoch-0"), ("R1", 2, "epoch-1"), ("R3", 1, "epoch-1")]
    counted = spark.read.parquet(f"{out}/counts").orderBy("epoch").collect()
    assert [(r.epoch, r.ingress, r.validated, r.quarantined) for r in counted] == [(0, 3, 1, 2), (1, 2, 2, 0)]
    q = spark.read.parquet(f"{out}/quarantine").orderBy("source_line").collect()
    assert [(r.source_line, r.reasons) for r in q] == [(2, ["invalid JSON"]), (3, ["eventYear 2099 out of range [1800–1950]"])]
    assert spark.read.parquet(f"{out}/manifest").first().line_count == 2

    stream = spark.readStream.schema(v.schema).parquet(f"{out}/validated").withColumn(
        "arrival", F.struct("batch_id", "source_key", "source_line"))
    table = str(tmp_path / "table")
    finish(ingest.stream_upsert(stream, table, spark.createDataFrame([], RECORDS), AT, buckets=4), tmp_path / "c2")
    got = bucketed.read_buckets(spark, table, RECORDS)
    assert {r.record_id: r.given_name for r in got.collect()} == {"R1": "Bea", "R3": "Ann"}

    vec = str(tmp_path / "vec")
    finish(ingest.stream_embed(spark.readStream.schema(v.schema).parquet(f"{out}/validated"), HashingEmbedder(8), "h", AT)
           .drop("error").writeStream.format("parquet").option("path", vec), tmp_path / "c3")
    assert spark.read.parquet(vec).where(F.size("embedding") == 8).count() == 3
