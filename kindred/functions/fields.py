"""Rules for landing lines: JSON objects in VARIANT form to typed fields and reasons.

Field access keeps three cases apart that a typed read would merge: missing, JSON
null, and a value of another type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.cleanse import redact_pii, title_case
from kindred.functions.common import compact, is_blank, staged, trim_ws
from kindred.schemas import LANDING_FIELDS, REQUIRED_FIELDS

# Bounds of the range rules.
EVENT_YEAR_MIN, EVENT_YEAR_MAX = 1800, 1950
AGE_MIN, AGE_MAX = 1, 110
YEARS = ("eventYear", "birthYear")
NAMES = ("givenName", "familyName")


def parse_line(c: Column) -> Column:
    """The line as VARIANT when it is a JSON object, else NULL."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def json_type(schema: Column) -> Column:
    """Type name (str, int, bool, float, list, dict, NoneType) from ``schema_of_variant`` text."""
    wide_int = schema.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")
    return (F.when(schema == "VOID", "NoneType")
            .when(schema == "STRING", "str")
            .when((schema == "BIGINT") | wide_int, "int")
            .when(schema == "BOOLEAN", "bool")
            .when(schema.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
            .when(schema.startswith("ARRAY"), "list")
            .when(schema.startswith("OBJECT"), "dict"))


def convert_fields(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``{field}`` and ``{field}_type`` per landing field: trimmed, names title-cased.

    Fields come out as strings except the years, which are BIGINT where they are
    integers or ASCII integer text. Types are those after conversion.
    """
    value = {f: F.try_variant_get(F.col(line), f"$.{f}", "variant") for f in LANDING_FIELDS}
    df = staged(df, {f"_v_{f}": v for f, v in value.items()})
    df = staged(df, {
        **{f"_k_{f}": F.schema_of_variant(f"_v_{f}") for f in value},
        **{f"_s_{f}": F.try_variant_get(f"_v_{f}", "$", "string") for f in value}})
    # a step of its own: ``json_type`` names the schema many times
    df = staged(df, {f"_t_{f}": json_type(F.col(f"_k_{f}")) for f in value})
    out: dict[str, Column] = {}
    for f in value:
        kind, text = F.col(f"_t_{f}"), F.col(f"_s_{f}")
        if f in YEARS:
            is_text_int = (kind == "str") & trim_ws(text).rlike(r"^[+-]?[0-9]+$")
            number = F.when((kind == "int") | is_text_int, trim_ws(text).try_cast("bigint"))
            out[f] = (F.when(kind == "bool", (text == "true").cast("bigint"))
                      # integers past 64 bits are integers out of every range
                      .when(kind == "int", F.coalesce(number, F.lit(2**63 - 1)))
                      .otherwise(number))
            out[f"{f}_type"] = F.when(is_text_int & number.isNotNull(), "int").otherwise(kind)
            # a number with a fraction part is no year to store, but the rules look at it
            out[f"{f}_fraction"] = F.when(kind == "float", text.try_cast("double"))
        else:
            clean = title_case(trim_ws(text)) if f in NAMES else trim_ws(text)
            out[f] = F.when(kind == "str", clean).otherwise(text)
            out[f"{f}_type"] = kind
    return staged(df, out).drop(*[f"_{k}_{f}" for f in value for k in "vkts"])


def _type(f: str) -> Column:
    return F.col(f"{f}_type")


def null_reasons() -> Column:
    """Required fields that are JSON null."""
    return compact(*[F.when(_type(f) == "NoneType", f"null required field: {f}")
                     for f in REQUIRED_FIELDS])


def schema_reasons() -> Column:
    """Required fields that are missing or of another type (bool passes for int)."""
    def one(f: str, want: str) -> Column:
        fits = (_type(f) == want) | ((_type(f) == "bool") if want == "int" else F.lit(False))
        return (F.when(_type(f).isNull(), f"missing required field: {f}")
                .when(~fits, F.concat(F.lit(f"wrong type for {f}: expected {want}, got "), _type(f))))
    birth = _type("birthYear")
    odd_birth = F.when(birth.isNotNull() & ~birth.isin("int", "bool", "NoneType", "float"),
                       F.concat(F.lit("wrong type for birthYear: expected int, got "), birth))
    return compact(*[one(f, want) for f, want in REQUIRED_FIELDS.items()], odd_birth)


def range_reasons() -> Column:
    """Event year, implied age and place must make sense."""
    event, fraction = F.col("eventYear"), F.col("birthYear_fraction")
    birth = F.coalesce(F.col("birthYear").cast("double"), fraction)
    age = event - birth
    # whole numbers print as such, fractions as decimals
    shown = lambda c: F.when(fraction.isNull(), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    in_range = event.between(EVENT_YEAR_MIN, EVENT_YEAR_MAX)
    text = lambda c: c.cast("string")
    return compact(
        F.when(~in_range, F.concat(F.lit("eventYear "), text(event), F.lit(
            f" out of range [{EVENT_YEAR_MIN}–{EVENT_YEAR_MAX}]"))),
        F.when(birth >= event, F.concat(F.lit("birthYear "), shown(birth),
                                        F.lit(" >= eventYear "), text(event)))
        .when(~age.between(AGE_MIN, AGE_MAX), F.concat(
            F.lit("implied age "), shown(age), F.lit(f" outside [{AGE_MIN}–{AGE_MAX}]"))),
        F.when(is_blank(F.col("location")), "location is empty after strip"))


def violations(df: DataFrame) -> DataFrame:
    """Add ``reasons``: the first rule group that objects, or an empty array."""
    df = staged(df, {"_null": null_reasons(), "_schema": schema_reasons()})
    # ranges are only looked at once the types are right
    reasons = (F.when(F.size("_null") > 0, F.col("_null"))
               .when(F.size("_schema") > 0, F.col("_schema"))
               .otherwise(range_reasons()))
    return staged(df, {"reasons": reasons}).drop("_null", "_schema")


def redacted_raw_content() -> Column:
    """``rawContent`` for a valid line: personal data removed from text values."""
    raw = F.col("rawContent")
    return F.when(_type("rawContent") == "str", redact_pii(raw)).otherwise(raw)


def dest_key(prefix: str, key: Column) -> Column:
    """Key with its first path component replaced; a key without one is prefixed."""
    return F.concat(F.lit(prefix + "/"), F.regexp_replace(key, "^[^/]*/", ""))


def ingest_defaults(df: DataFrame) -> DataFrame:
    """Fill source and compute_embedding; keep rows with non-blank id and names."""
    return (df.where(~is_blank(F.col("record_id")) & ~is_blank(F.col("given_name"))
                     & ~is_blank(F.col("family_name")))
            .withColumns({
                "source": F.when(is_blank(F.col("source")), "ingest-api").otherwise(F.col("source")),
                "compute_embedding": F.coalesce("compute_embedding", F.lit(True))}))
