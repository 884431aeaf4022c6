import pytest
from pyspark.sql import functions as F

from kindred.functions import cleanse as cl
from kindred.functions import text as tx
from kindred.functions.rules import infer_gender


def apply(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r.v for r in df.select("i", fn(F.col("c")).alias("v")).orderBy("i").collect()]


def test_ocr_years(spark):
    cases = {"18S0": "1850", "185O": "1850", "l850": "1850", "I850": "1850", "18SO": "1850",
             "lSSO": "1550", "1850": "1850", "SF": "SF", "born 18S0, died l9O1": "born 1850, died 1901",
             "x18S0": "x18S0", "18S00": "18S00", "llll": "1111", "": "", "  ": "  ", None: None}
    assert apply(spark, cl.fix_ocr_years, list(cases)) == list(cases.values())


def test_locations(spark):
    cases = {"NYC": "New York City", "PHL": "Philadelphia", "philly": "Philadelphia", "stl": "St. Louis",
             "Born in Philly, died in NYC": "Born in Philadelphia, died in New York City",
             "Chicago": "Chicago", "Atlas": "Atlas", "Washington DC": "Washington Washington DC",
             "": "", None: None}
    assert apply(spark, cl.standardize_location, list(cases)) == list(cases.values())


def test_chain_and_extra_step(spark):
    assert apply(spark, cl.cleanse, ["John Smith, Philly, 18S0", None, " "]) == [
        "John Smith, Philadelphia, 1850", None, " "]
    step = cl.register_cleanser(lambda c: F.regexp_replace(c, r"(?i)circa (\d{4})", "$1"))
    try:
        assert apply(spark, cl.cleanse, ["circa 18S0"]) == ["1850"]
    finally:
        cl.unregister_cleanser(step)
    assert apply(spark, cl.cleanse, ["circa 18S0"]) == ["circa 1850"]


def test_chain_works_each_step_out_once(spark):
    df = spark.createDataFrame([("18S0 in NYC",)], "c string")
    plan = df.select(cl.cleanse(F.col("c")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3


def test_redaction(spark):
    got = apply(spark, cl.redact_pii, ["a 123-45-6789 b", "mail x.y+z@example.co.uk now",
                                       "call (617) 555-1212 or 617.555.1212", "year 1850"])
    assert got == ["a [REDACTED] b", "mail [REDACTED] now", "call [REDACTED] or [REDACTED]", "year 1850"]


def test_title_case(spark):
    cases = ["o'brien", "MARY-ANN", "2nd lt", "élan vital", "", None]
    assert apply(spark, cl.title_case, cases) == [None if c is None else c.title() for c in cases]


@pytest.mark.parametrize("year,loc,want", [
    (1850, "Boston", "givenName=A familyName=B year=1850 location=Boston"),
    (None, " ", "givenName=A familyName=B"), (None, None, "givenName=A familyName=B")])
def test_embedding_text(spark, year, loc, want):
    df = spark.createDataFrame([("A", "B", year, loc)], "g string, f string, y int, l string")
    assert df.select(tx.embedding_text(*map(F.col, "gfyl")).alias("t")).first().t == want


def test_variant_and_gender(spark):
    assert apply(spark, tx.given_name_variant, ["Jon", "JOHN", "Mary"]) == ["john", "jon", "Mary"]
    assert apply(spark, infer_gender, [" john ", "Mary", "Leslie", "Zxqvr", None, ""]) == [
        "MALE", "FEMALE", "AMBIGUOUS", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
