"""Dimensions as tables of any size, against plain dictionaries."""
import re

from pyspark.sql import functions as F

from kindred.functions import cleanse as cl
from kindred.functions.rules import check_pairs
from kindred.operators.candidates import match_exact
from kindred.operators.dimensions import with_gender, with_places, with_variant

N = 100_000


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_equal_a_plain_dictionary(spark):
    known = {f"w{i}": f"Place {i}" for i in range(N)}
    table = spark.range(N).select(F.concat(F.lit("w"), "id").alias("short"), F.concat(F.lit("Place "), "id").alias("full"))
    table = table.union(table.limit(5)).union(spark.sql("SELECT CAST(NULL AS STRING), 'x'")).union(spark.sql("SELECT 'none', CAST(NULL AS STRING)"))
    texts = ["W5, then w99999.", "w100000 none", "", None, "w5w5 w5_ w5", " W7\tw8\nw7 ", "É w1é", "no hit"] * 3
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "i int, place string, _found_ string, short string")
    got = with_places(df, "place", table)
    assert got.columns == df.columns
    want = [t if t is None else re.sub("[A-Za-z0-9_]+", lambda m: known.get(m[0].lower(), m[0]), t) for t in texts]
    assert [r["place"] for r in got.orderBy("i").collect()] == want
    assert with_places(df.where("i < 0"), "place", table).count() == 0
    assert len(plan(got)) < 20_000


def test_one_pass_equals_one_pattern_each(spark):
    texts = ["NYC and ny", "la_la LA", "Stl. sf;dc", "", "x"]
    own = {"ny": "N$1", "la": "L\\A", "st. l": "Saint L"}
    df = spark.createDataFrame([(t,) for t in [*texts, "St. L ny"]], "t string")
    got = [r[0] for r in df.select(cl.standardize_location(F.col("t"), own)).collect()]
    assert got == ["NYC and N$1", "la_la L\\A", "Stl. sf;dc", "", "x", "Saint L N$1"]
    assert plan(df.select(cl.standardize_location(F.col("t")))).count("regexp_replace") == 0


def test_names_from_tables(spark):
    genders = spark.createDataFrame([(" Zoe", "FEMALE"), ("zoe", "FEMALE"), ("Kim", "MALE"), (None, "MALE")], "name string, gender string")
    people = spark.createDataFrame([(1, "ZOE "), (2, "kim"), (3, "John"), (4, None)], "i int, given string")
    assert [r["gender"] for r in with_gender(people, "given", genders).orderBy("i").collect()] == ["FEMALE", "MALE", "UNKNOWN", "UNKNOWN"]
    variants = spark.createDataFrame([("Zoe", "zoey"), ("zoe", "zz")], "name string, variant string")
    assert [r["variant"] for r in with_variant(people.where("i <> 1").union(spark.createDataFrame([(1, "Zoe")], people.schema)), "given", variants)
            .orderBy("i").collect()] == ["zoey", "kim", "John", None]


def test_rules_take_a_gender_table(spark):
    row = {"from_id": "a", "to_id": "b", "from_given": "Zoe", "to_given": "Kim", "from_location": "Boston", "to_location": "Boston",
           "from_year": 1850, "to_year": 1860}
    pairs = spark.createDataFrame([row])
    genders = spark.createDataFrame([("zoe", "FEMALE"), ("kim", "MALE")], "name string, gender string")
    hit = lambda g: check_pairs(pairs, genders=g).first()["spatio"]["rules_triggered"]
    assert hit(genders) == hit({"zoe": "FEMALE", "kim": "MALE"}) == ["GenderPlausibilityRule"]
    assert hit(None) == []


def test_search_takes_a_variant_table(spark):
    records = spark.createDataFrame([("r1", "Zoe", "Hill", 1850, None), ("r2", "Zoey", "Hill", 1851, None), ("r3", "Zo", "Hill", 1851, None)],
                                    "record_id string, given_name string, family_name string, event_year int, location string")
    from kindred.schemas import RECORDS
    have = set(records.columns)
    records = records.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in RECORDS.fields if f.name not in have])
    asked = spark.createDataFrame([(1, "zoe", "hill", 1850, None)], "query_id long, given_name string, family_name string, approx_year int, location string")
    variants = spark.createDataFrame([("zoe", "Zoey")], "name string, variant string")
    found = lambda v: [r["record_id"] for r in match_exact(asked, records, variants=v).orderBy("rank").collect()]
    assert found(variants) == found({"zoe": "zoey"}) == ["r1", "r2"]
    assert found(None) == ["r1"]


def test_texts_are_not_shuffled_with_their_words(spark):
    """Only a digest goes with a word, and a word goes once per text however often the text has it."""
    words = spark.createDataFrame([("ny", "New York"), ("la", "Los Angeles")], "short string, full string")
    rows = [(1, "ny, NY and LA " + "x" * 500), (2, "ny, NY and LA " + "x" * 500), (3, None), (4, "nyla"), (5, "")]
    got = with_places(spark.createDataFrame(rows, "i int, place string"), "place", words)
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in joined and "array_distinct" in joined
    want = "New York, New York and Los Angeles " + "x" * 500
    assert {r.i: r.place for r in got.collect()} == {1: want, 2: want, 3: None, 4: "nyla", 5: ""}
