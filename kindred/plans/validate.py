"""Landing lines to validated and quarantined rows, manifests and replays."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from kindred.functions.common import staged
from kindred.functions.fields import (
    convert_fields,
    dest_key,
    json_type,
    parse_line,
    redacted_raw_content,
    violations,
)
from kindred.operators.ranking import top_k
from kindred.schemas import LANDING_FIELDS, MANIFEST_REPLAYS, PROVENANCE

RAW_PREVIEW = 200
# Error texts that go into a file's summary row; ``ingest_errors`` has all of them as rows.
FILE_ERRORS = 20
REPLAY_ERRORS = 10
# Why a file is refused whole.
EMPTY_FILE, NO_JSON = "empty file", "no valid JSON lines"


class Routed(NamedTuple):
    validated: DataFrame
    quarantine: DataFrame


def file_verdicts(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(source_key, ingress, json_ok, file_reason): which files are refused as a whole."""
    counts = lines.groupBy("source_key").agg(
        F.count("*").alias("ingress"),
        F.count_if(parse_line(F.col("value")).isNotNull()).alias("json_ok"))
    zero = F.lit(0).cast("long")
    return files.select("source_key").join(counts, "source_key", "left").select(
        "source_key",
        F.coalesce("ingress", zero).alias("ingress"),
        F.coalesce("json_ok", zero).alias("json_ok"),
        F.when(F.col("ingress").isNull(), EMPTY_FILE)
        .when(F.col("json_ok") == 0, NO_JSON).alias("file_reason"))


def checked_lines(lines: DataFrame, batch_id: str | Column) -> DataFrame:
    """Every line with its typed fields, ``reasons`` and provenance; one projection."""
    batch = F.lit(batch_id) if isinstance(batch_id, str) else batch_id
    parsed = staged(lines, {"line": parse_line(F.col("value"))})
    ruled = violations(convert_fields(parsed))
    bad_json = F.col("line").isNull()
    raw = F.when(bad_json, F.col("value"))
    return ruled.withColumns({
        "reasons": F.when(bad_json, F.array(F.lit("invalid JSON"))).otherwise(F.col("reasons")),
        "raw": raw, "raw_preview": F.left(raw, F.lit(RAW_PREVIEW)),
        "batch_id": batch})


def _extra() -> Column:
    """JSON text of the fields that have no column of their own, or whose value does not fit it."""
    fields = F.map_filter(F.try_variant_get("line", "$", "map<string, variant>"), lambda k, v: ~k.isin(
        *LANDING_FIELDS) | ((k == "birthYear") & F.col("birthYear_fraction").isNotNull()))
    return F.when(F.size(fields) > 0, F.to_json(fields))


def _typed(df: DataFrame) -> DataFrame:
    """Validated fields under the records table's column names and types."""
    return df.select(
        F.col("recordId").alias("record_id"),
        F.col("givenName").alias("given_name"),
        F.col("familyName").alias("family_name"),
        F.col("eventYear").cast("int").alias("event_year"),
        F.col("birthYear").try_cast("int").alias("birth_year"),
        "location", "source",
        redacted_raw_content().alias("raw_content"),
        F.col("computeEmbedding").try_cast("boolean").alias("compute_embedding"),
        _extra().alias("extra"), *PROVENANCE)


def route(lines: DataFrame, batch_id: str | Column) -> Routed:
    """Split lines into validated and quarantined rows, provenance on both.

    Every line comes out once. Lines of a file without a single JSON object are quarantined
    with ``file_reason``; bad lines keep their whole text in ``raw``, objects all their
    fields in ``record``, and validated lines the fields without a column in ``extra``. The two
    results share one parse; write them from a persisted or checkpointed input, or
    with one write partitioned by outcome.
    """
    checked = checked_lines(lines, batch_id)
    # files are judged by the parse alone: steps of ``checked`` would all run again
    refused = (lines.groupBy("source_key").agg(F.count(parse_line(F.col("value"))).alias("n"))
               .where("n = 0").select("source_key", F.lit(NO_JSON).alias("file_reason")))
    bad = checked.where(F.size("reasons") > 0).join(refused, "source_key", "left")
    quarantine = bad.select(
        *PROVENANCE, "reasons", "file_reason", "raw", "raw_preview", F.col("line").alias("record"),
        *LANDING_FIELDS)
    return Routed(_typed(checked.where(F.size("reasons") == 0)), quarantine)


def validation_summary(lines: DataFrame, batch_id: str = "") -> DataFrame:
    """Per file: lines in, validated, quarantined (a file without JSON is quarantined whole)."""
    return checked_lines(lines, batch_id).groupBy("source_key").agg(
        F.count("*").alias("ingress"),
        F.count_if(F.size("reasons") == 0).alias("validated"),
        F.count_if(F.size("reasons") > 0).alias("quarantined"))


def observed(routed: Routed, name: str = "lines") -> tuple[Routed, dict[str, Observation]]:
    """``routed`` with a count of either side that comes with its write, without another pass.

    Read ``observations["validated"].get["n"]`` and ``["quarantined"]`` after the writes.
    """
    seen = {side: Observation(f"{name}-{side}") for side in ("validated", "quarantined")}
    count = F.count(F.lit(1)).alias("n")
    return Routed(routed.validated.observe(seen["validated"], count), routed.quarantine.observe(seen["quarantined"], count)), seen


def metered(checked: DataFrame, name: str = "validation") -> DataFrame:
    """``checked_lines`` with the totals of ``validation_summary`` as metrics of whatever runs it, batch or stream."""
    return checked.observe(name, F.count(F.lit(1)).alias("ingress"), F.count_if(F.size("reasons") == 0).alias("validated"),
                           F.count_if(F.size("reasons") > 0).alias("quarantined"))


class ValidationMeter(StreamingQueryListener):
    """Totals of ``metered`` streams as they run: ``spark.streams.addListener(meter)``, then ``meter.totals[query name]``."""

    def __init__(self, name: str = "validation"):
        self.name = name
        self.totals: dict[str, Counter] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.totals.setdefault(event.progress.name, Counter()).update(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def quarantine_reasons(quarantine: DataFrame) -> DataFrame:
    """(source_key, reason, lines, first_line, first_pos): one row per distinct reason and file.

    A file that was refused whole has that one reason.
    """
    reasons = F.when(F.col("file_reason").isNotNull(), F.array("file_reason")).otherwise(F.col("reasons"))
    return quarantine.select("source_key", "source_line",
                             F.posexplode(reasons).alias("pos", "reason")).groupBy(
        "source_key", "reason").agg(
        F.count("*").alias("lines"),
        F.min(F.struct("source_line", "pos")).alias("first")).select(
        "source_key", "reason", "lines", F.col("first.source_line").alias("first_line"),
        F.col("first.pos").alias("first_pos"))


def quarantine_manifest(quarantine: DataFrame, at, empty: DataFrame | None = None,
                        batch_id: str | None = None, most: int | None = None) -> DataFrame:
    """One row per quarantined file: line count, all distinct reasons as first seen, pending.

    ``empty``: source_key of files without a line, which get a row under ``batch_id``. Reasons are made distinct by key before
    they meet in the array of their file; ``most`` keeps the first so many. ``quarantine_reasons`` has them as rows.
    """
    counts = quarantine.groupBy("source_key").agg(
        F.count("*").alias("line_count"), F.min("batch_id").alias("batch_id"))
    first = top_k(quarantine_reasons(quarantine), ["source_key"],
                  [F.col("first_line"), F.col("first_pos"), F.col("reason")], most)
    seen = first.groupBy("source_key").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("first_line", "first_pos", "reason"))),
        lambda x: x["reason"]).alias("reasons"))
    files = counts.join(seen, "source_key")
    if empty is not None:
        files = files.unionByName(empty.select(
            "source_key", F.lit(0).cast("long").alias("line_count"), F.lit(batch_id).cast("string").alias("batch_id"),
            F.array(F.lit(EMPTY_FILE)).alias("reasons")))
    return files.select(
        dest_key("quarantine", F.col("source_key")).alias("quarantine_key"),
        "source_key", "batch_id", F.lit(at).cast("timestamp").alias("quarantined_at"),
        "line_count", "reasons", F.lit("pending").alias("replay_status"),
        F.array().cast(MANIFEST_REPLAYS).alias("replays"))


def replay_quarantine(quarantine: DataFrame) -> DataFrame:
    """Quarantined lines in landing shape again, without audit fields.

    The line is the JSON object as it came in (its own ``_`` audit keys dropped when
    it was read back from a quarantine file), or the kept raw text.
    """
    drop = ["_sourceKey", "_sourceLine", "_batchId", "_reasons", "_reason", "_raw"]
    record = F.col("record")
    if quarantine.schema["record"].dataType.typeName() == "string":  # as a stored quarantine has it
        record = F.try_parse_json(record)
    fields = F.map_filter(F.try_variant_get(record, "$", "map<string, variant>"),
                          lambda k, v: ~k.isin(drop))
    return quarantine.select(
        dest_key("quarantine", F.col("source_key")).alias("source_key"), "source_line",
        F.coalesce(F.to_json(fields), F.col("raw")).alias("value"))


def update_manifest(manifest: DataFrame, replays: DataFrame, at) -> DataFrame:
    """Append replay results (quarantine_key, replay_batch_id, ok, failed, errors) to manifests.

    A key without a manifest starts an empty one. Status is ``replayed`` when
    nothing failed, else ``partial``.
    """
    entry = F.struct(
        F.lit(at).cast("timestamp").alias("replayed_at"), "replay_batch_id",
        F.col("ok").cast("long").alias("ok"), F.col("failed").cast("long").alias("failed"),
        F.slice("errors", 1, REPLAY_ERRORS).alias("errors"))
    results = replays.select("quarantine_key", entry.alias("_entry"))
    merged = manifest.join(results, "quarantine_key", "full_outer")
    done = F.col("_entry").isNotNull()
    history = F.coalesce("replays", F.array().cast(MANIFEST_REPLAYS))
    return merged.withColumns({
        "replays": F.when(done, F.concat(history, F.array("_entry"))).otherwise(F.col("replays")),
        "replay_status": F.when(done, F.when(F.col("_entry.failed") == 0, "replayed")
                                .otherwise("partial"))
        .otherwise(F.col("replay_status"))}).select(*manifest.columns)


def ingest_outcomes(lines: DataFrame) -> DataFrame:
    """(source_key, source_line, outcome): failed, skipped or ok for each line to store."""
    record = F.try_parse_json("value")
    # JSON values that count as empty: null, "", 0, false, [], {}
    def empty(f: str) -> Column:
        value = F.try_variant_get(record, f"$.{f}", "variant")
        text, kind = F.try_variant_get(record, f"$.{f}", "string"), json_type(F.schema_of_variant(value))
        return (F.when(text.isNull(), True).when(kind == "str", text == "")
                .when(kind.isin("int", "float"), text.try_cast("double") == 0)
                .otherwise(text.isin("false", "[]", "{}")))

    missing = empty("recordId") | empty("givenName") | empty("familyName")
    return lines.select("source_key", "source_line", "value",
                        F.when(parse_line(F.col("value")).isNull(), "failed")
                        .when(missing, "skipped").otherwise("ok").alias("outcome"))


def ingest_errors(lines: DataFrame) -> DataFrame:
    """(source_key, source_line, error): every line that failed."""
    return ingest_outcomes(lines).where(F.col("outcome") == "failed").select(
        "source_key", "source_line", F.lit("invalid JSON").alias("error"))


def ingest_summary(lines: DataFrame) -> DataFrame:
    """Per file: totals by outcome and the first FILE_ERRORS failing line numbers (all: ``ingest_errors``)."""
    out = ingest_outcomes(lines)
    count = lambda o: F.count_if(F.col("outcome") == o)
    totals = out.groupBy("source_key").agg(
        F.count("*").alias("total"), count("ok").alias("ok"),
        count("skipped").alias("skipped"), count("failed").alias("failed"))
    first = top_k(out.where(F.col("outcome") == "failed"), ["source_key"],
                  [F.col("source_line")], FILE_ERRORS)
    errors = first.groupBy("source_key").agg(F.transform(
        F.array_sort(F.collect_list("source_line")),
        lambda n: F.concat(F.lit("line "), n.cast("string"), F.lit(": invalid JSON"))
    ).alias("errors"))
    return totals.join(errors, "source_key", "left").withColumn(
        "errors", F.coalesce("errors", F.array().cast("array<string>")))
