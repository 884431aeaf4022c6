import pytest
from pyspark.sql import functions as F

from checks import queries
from kindred.functions import rules as ru
from kindred.functions.transit import available_days, geocode, haversine_miles, transit_estimate
from kindred.operators import graph

SCHEMA = ("from_id string, from_given string, from_location string, from_year int, from_month int, "
          "from_birth int, to_id string, to_given string, to_location string, to_year int, "
          "to_month int, to_birth int")


def pair(spark, **kw):
    base = dict(from_id="a", from_given="John", from_location="Boston", from_year=1850, from_month=None,
                from_birth=None, to_id="b", to_given="John", to_location="Boston", to_year=1850,
                to_month=None, to_birth=None)
    base.update(kw)
    return spark.createDataFrame([tuple(base.values())], SCHEMA)


def verdicts(spark, travel, available, **kw):
    df = pair(spark, **kw).withColumns({
        "travel_days": F.lit(float(travel)), "available_days": F.lit(float(available)),
        "transit_mode": F.lit("railroad_eastern")})
    rows = ru.evaluate_rules(df).select(F.inline("rule_results")).collect()
    return {r.rule_name: (r.triggered, r.implausible, r.penalty) for r in rows}, {
        r.rule_name: r.reason for r in rows}


@pytest.mark.parametrize("travel,available,rule,want", [
    (10, 5, "physical_impossibility", (True, True, 50)),
    (10, 10, "physical_impossibility", (False, False, 0)),
    (8, 10, "narrow_margin", (True, False, 15)),
    (10, 10, "narrow_margin", (True, False, 15)),
    (2, 100, "narrow_margin", (False, False, 0)),
    (10, 5, "narrow_margin", (False, False, 0))])
def test_travel_rules(spark, travel, available, rule, want):
    assert verdicts(spark, travel, available)[0][rule] == want


@pytest.mark.parametrize("rid,want", [("BORN:1860:R", True), ("BORN:1700:R", True), ("BORN:1820:R", False),
                                      ("BORN:18x0:R", False), ("R-1", False)])
def test_biology_from_id(spark, rid, want):
    got, why = verdicts(spark, 1, 50, from_id=rid)
    assert got["biological_plausibility"][0] is want
    if rid in ("R-1", "BORN:18x0:R"):
        assert "skipped" in why["biological_plausibility"]


@pytest.mark.parametrize("a,b,want", [(1820, 1820, (False, False, 0)), (1820, 1780, (True, True, 40)),
                                      (1700, 1700, (True, True, 50)), (None, None, (False, False, 0)),
                                      (1820, None, (False, False, 0))])
def test_ages(spark, a, b, want):
    assert verdicts(spark, 1, 50, from_birth=a, to_birth=b)[0]["AgeConsistencyRule"] == want


@pytest.mark.parametrize("a,b,points", [("John", "Mary", 20), ("John", "Jon", 0), ("Leslie", "Leslie", 0),
                                        ("Zxqvr", "Mary", 0), (None, "Mary", 0)])
def test_gender(spark, a, b, points):
    got = verdicts(spark, 1, 50, from_given=a, to_given=b)[0]["GenderPlausibilityRule"]
    assert got == (points > 0, False, points)


@pytest.mark.parametrize("y1,m1,y2,m2,want", [
    (1850, None, 1851, None, 365.0), (1850, 1, 1850, 7, 180.0), (1850, None, 1850, None, 182.5),
    (1850, 3, 1850, 3, 1.0), (1850, 3, 1850, None, 1.0), (1851, 1, 1850, 7, 185.0)])
def test_available_days(spark, y1, m1, y2, m2, want):
    df = spark.createDataFrame([(y1, m1, y2, m2)], "a int, b int, c int, d int")
    assert df.select(available_days(*map(F.col, "abcd")).alias("d")).first().d == want


@pytest.mark.parametrize("a,b,year,mode,low,high", [
    ("Boston", "Philadelphia", 1840, "railroad_eastern", 1, 3),
    ("Boston", "San Francisco", 1848, "ocean_ship", 100, 200),
    ("Boston", "San Francisco", 1820, "ocean_ship", 100, 200),
    ("Boston", "San Francisco", 1870, "railroad_transcontinental", 5, 15),
    ("Boston", "Philadelphia", 1820, "horse_coach", 4, 8)])
def test_transit(spark, a, b, year, mode, low, high):
    r = transit_estimate(pair(spark, from_location=a, to_location=b, from_year=year)).first()
    assert r.transit_mode == mode and low <= r.travel_days <= high


def test_geocode_and_distance(spark):
    df = spark.createDataFrame([("Boston", None, None), ("Nowhere", None, None), (None, None, None),
                                ("Boston", 51.5, -0.1), (" ALBANY ", None, None), ("Boston", 1.0, None)],
                               "l string, la double, lo double")
    got = [(r.geo_lat, r.geo_lon) for r in geocode(df, "l", "la", "lo").collect()]
    assert got == [(42.36, -71.06), (39.5, -98.35), (39.5, -98.35), (51.5, -0.1), (42.65, -73.75), (42.36, -71.06)]
    cities = spark.createDataFrame([("Nowhere", 1.0, 2.0)], "name string, lat double, lon double")
    own = {r.l: (r.geo_lat, r.geo_lon) for r in geocode(df.where("la is null"), "l", "la", "lo", cities=cities).collect()}
    assert own["Nowhere"] == (1.0, 2.0) and own["Boston"] == (39.5, -98.35)
    d = spark.range(1).select(haversine_miles(*map(F.lit, (42.36, -71.06, 40.71, -74.01))).alias("d")).first().d
    assert abs(d - 190) < 20


def test_chain_caps_and_maps(spark):
    df = pair(spark, from_location="Boston", to_location="San Francisco", from_month=1, to_month=2,
              from_birth=1700, to_birth=1700, to_given="Mary")
    s = ru.check_pairs(df).first().spatio
    assert not s.plausible and s.confidence_adjustment == 50
    assert s.rules_triggered == ["physical_impossibility", "biological_plausibility",
                                 "AgeConsistencyRule", "GenderPlausibilityRule"]
    assert s.rule_penalties == {"physical_impossibility": 50, "biological_plausibility": 50,
                                "AgeConsistencyRule": 50, "GenderPlausibilityRule": 20}
    assert s.travel_days == pytest.approx(120.0) and s.available_days == 30.0
    # a filter on the result must not blow up the plan
    assert ru.check_pairs(df).where("spatio.plausible").count() == 0


def test_registered_rule(spark):
    rule = ru.register_rule("same_place", 6, lambda p: ru.rule_result(
        p.src.location == p.dst.location, F.lit(False), F.lit(1), F.lit("same")))
    try:
        assert ru.check_pairs(pair(spark)).first().spatio.rules_triggered == ["same_place"]
    finally:
        ru.unregister_rule(rule)
    assert ru.check_pairs(pair(spark)).first().spatio.rules_triggered == []


def test_tiers_and_verdict(spark):
    df = spark.createDataFrame([(100.0, 10.0), (50.0, 10.0), (20.0, 10.0), (10.0, 10.0), (5.0, 10.0), (5.0, 0.0)],
                               "a double, t double")
    assert [r.x for r in df.select(graph.margin_tier(F.col("a"), F.col("t")).alias("x")).collect()] == [
        "very_comfortable", "comfortable", "moderate", "tight", "impossible", "very_comfortable"]


def test_gender_conflicts_infer_each_name_once(spark, monkeypatch):
    pairs = spark.createDataFrame([("a", "b", "John", "Mary"), ("a", "c", "John", "Thomas"), ("b", "d", None, "Zxqvr")],
                                  "from_id string, to_id string, from_given string, to_given string")
    monkeypatch.setattr(queries, "_pairs", lambda spark, sf: pairs)
    found = queries.gender_conflicts(spark, "")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2
    assert [tuple(r) for r in found.collect()] == [("a", "b", "MALE", "FEMALE")]
