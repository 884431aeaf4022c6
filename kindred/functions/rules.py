"""Plausibility rules over record pairs, and the chain that combines them.

A rule is a function from a ``Pair`` of columns to a struct column; the chain is
one narrow projection over the pair table. Ages, verdicts and genders are also
usable on their own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.common import literal_map, staged, trim_ws
from kindred.functions.dims import NAME_GENDER
from kindred.functions.transit import available_days, geocode, transit_estimate

# Fixed values of the rule model.
MIN_AGE, MAX_AGE = 0, 120
AGE_DELTA_SLACK = 5
NARROW_MARGIN_DAYS = 5
PENALTY_IMPOSSIBLE = 50
PENALTY_BIOLOGY = 50
PENALTY_AGE_CONTRADICTS = 40
PENALTY_AGE_IMPLAUSIBLE = 50
PENALTY_GENDER = 20
PENALTY_NARROW = 15
MAX_ADJUSTMENT = 50


@dataclass(frozen=True)
class Anchor:
    """One side of a pair."""

    id: Column
    given: Column
    location: Column
    year: Column
    month: Column
    birth: Column
    gender: Column
    #: The birth year that the id carries.
    born: Column | None = None


@dataclass(frozen=True)
class Pair:
    """What a rule may look at."""

    src: Anchor
    dst: Anchor
    travel_days: Column
    available_days: Column
    mode: Column

    @property
    def margin(self) -> Column:
        return self.available_days - self.travel_days


#: What a rule may look at: the fields of both sides; the birth year that an id carries (of sides without one of their own);
#: the days of travel, those available, and the mode.
USES = ("id", "given", "location", "year", "month", "birth", "born", "travel")


@dataclass(frozen=True)
class Rule:
    name: str
    order: int
    check: Callable[[Pair], Column]
    #: What the rule looks at on either side (see USES), so that pairs that agree in it are checked once; None: everything.
    uses: tuple[str, ...] | None = None


def rule_result(triggered: Column, implausible: Column, penalty: Column, reason: Column) -> Column:
    """The struct every rule returns (the chain adds its name)."""
    return F.struct(
        F.coalesce(triggered, F.lit(False)).alias("triggered"),
        F.coalesce(implausible, F.lit(False)).alias("implausible"),
        penalty.cast("int").alias("penalty"),
        reason.alias("reason"),
    )


def _points(triggered: Column, points: int) -> Column:
    return F.when(triggered, points).otherwise(0)


# --- ages -----------------------------------------------------------------

def age_at(birth_year: Column, event_year: Column) -> Column:
    """Age implied by a birth year; NULL when unknown."""
    return event_year - birth_year


def is_age_viable(birth_year: Column, event_year: Column) -> Column:
    """Within a human lifespan; an unknown birth year counts as viable."""
    return F.coalesce(age_at(birth_year, event_year).between(MIN_AGE, MAX_AGE), F.lit(True))


def birth_year_from_id(record_id: Column) -> Column:
    """Birth year carried by ids of the form ``BORN:YYYY:rest``."""
    digits = F.regexp_extract(record_id, r"^BORN:([+-]?[0-9]+)(?::|$)", 1)
    # a failed cast costs an exception, so only ids of that form get there
    return F.when(record_id.startswith("BORN:"), digits.try_cast("int"))


def born_id(record_id: Column) -> Column:
    """The part of an id that carries a birth year; NULL where there is none."""
    return F.nullif(F.regexp_extract(record_id, r"^(BORN:[+-]?[0-9]+)(?::|$)", 1), F.lit(""))


def age_verdict(src_year: Column, src_birth: Column, dst_year: Column, dst_birth: Column) -> Column:
    """struct(verdict, age_from, age_to, year_delta, age_delta, reason).

    A side without a birth year borrows the other side's.
    """
    age_from = age_at(F.coalesce(src_birth, dst_birth), src_year)
    age_to = age_at(F.coalesce(dst_birth, src_birth), dst_year)
    year_delta = dst_year - src_year
    age_delta = F.abs(age_to - age_from)
    viable = age_from.between(MIN_AGE, MAX_AGE) & age_to.between(MIN_AGE, MAX_AGE)
    known = F.coalesce(src_birth, dst_birth).isNotNull()
    verdict = (F.when(~known, "UNKNOWN")
               .when(~viable, "IMPLAUSIBLE")
               .when(age_delta > F.abs(year_delta) + AGE_DELTA_SLACK, "CONTRADICTS")
               .otherwise("CONSISTENT"))
    # pieces put together, as a format would be read again for every pair
    told = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    sentence = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else told(p) for p in parts])
    signed = F.concat(F.when(year_delta >= 0, "+").otherwise(""), told(year_delta))
    reason = (
        F.when(~known, "No birth year available on either record; age consistency check skipped.")
        .when(~viable, sentence("Implied ages (", age_from, ", ", age_to, f") outside viable range [{MIN_AGE}, {MAX_AGE}]."))
        .when(age_delta > F.abs(year_delta) + AGE_DELTA_SLACK, sentence(
            "Age delta ", age_delta, " exceeds year delta ", F.abs(year_delta), " by more than 5 — records contradict same-person "
            "identity."))
        .otherwise(sentence("Ages consistent: ", age_from, " at ", src_year, " → ", age_to, " at ", dst_year,
                            " (year delta ", signed, ", age delta ", age_delta, ").")))
    return F.struct(
        verdict.alias("verdict"), age_from.alias("age_from"), age_to.alias("age_to"),
        F.when(known, year_delta).alias("year_delta"), age_delta.alias("age_delta"),
        reason.alias("reason"))


def infer_gender(given: Column, genders: Mapping[str, str] | None = None) -> Column:
    """MALE, FEMALE, AMBIGUOUS or UNKNOWN from a given name; ``genders`` replaces the built-in names."""
    return F.coalesce(
        F.try_element_at(literal_map(NAME_GENDER if genders is None else genders), F.lower(trim_ws(given))), F.lit("UNKNOWN"))


# --- rules ----------------------------------------------------------------

def physical_impossibility(p: Pair) -> Column:
    """The journey takes longer than the time between the two events."""
    hit = p.travel_days > p.available_days
    return rule_result(hit, hit, _points(hit, PENALTY_IMPOSSIBLE), F.when(
        hit, F.format_string("Travel requires %.1f days but only %.1f days available (mode: %s).",
                             p.travel_days, p.available_days, p.mode)
    ).otherwise("Travel is physically possible."))


def biological_plausibility(p: Pair) -> Column:
    """Both events must fall within one lifespan of the known birth year."""
    born = lambda a: birth_year_from_id(a.id) if a.born is None else a.born
    birth = F.coalesce(p.src.birth, born(p.src), p.dst.birth, born(p.dst))
    ages = age_at(birth, p.src.year), age_at(birth, p.dst.year)
    hit = ~(ages[0].between(MIN_AGE, MAX_AGE) & ages[1].between(MIN_AGE, MAX_AGE))
    return rule_result(hit, hit, _points(hit, PENALTY_BIOLOGY), F.when(
        birth.isNull(), "No birth year available; biological check skipped."
    ).when(hit, F.format_string(
        f"Implied ages (%d, %d) are outside plausible range [{MIN_AGE}, {MAX_AGE}].", *ages)
    ).otherwise(F.format_string("Ages at records (%d, %d) are biologically plausible.", *ages)))


def age_consistency(p: Pair) -> Column:
    """Ages must advance with the calendar and stay within a lifespan."""
    v = age_verdict(p.src.year, p.src.birth, p.dst.year, p.dst.birth)
    contradicts, implausible = v["verdict"] == "CONTRADICTS", v["verdict"] == "IMPLAUSIBLE"
    hit = contradicts | implausible
    return rule_result(
        hit, hit,
        F.when(contradicts, PENALTY_AGE_CONTRADICTS)
        .when(implausible, PENALTY_AGE_IMPLAUSIBLE).otherwise(0),
        v["reason"])


def gender_plausibility(p: Pair) -> Column:
    """Given names that suggest different genders cost points, no more."""
    a, b = p.src.gender, p.dst.gender
    clear = a.isin("MALE", "FEMALE") & b.isin("MALE", "FEMALE")
    hit = clear & (a != b)
    name = lambda c: F.coalesce(c, F.lit("null"))
    return rule_result(hit, F.lit(False), _points(hit, PENALTY_GENDER), F.when(
        ~clear, F.format_string("skipped — gender ambiguous or unknown for '%s'/'%s'",
                                name(p.src.given), name(p.dst.given))
    ).when(hit, F.format_string("gender conflict: '%s' inferred %s vs '%s' inferred %s",
                                name(p.src.given), a, name(p.dst.given), b)
    ).otherwise(F.format_string("gender consistent: both inferred %s", a)))


def narrow_margin(p: Pair) -> Column:
    """Possible but tight journeys cost points, no more."""
    hit = (p.margin >= 0) & (p.margin < NARROW_MARGIN_DAYS)
    return rule_result(hit, F.lit(False), _points(hit, PENALTY_NARROW), F.when(
        hit, F.format_string(
            f"Margin of %.1f days is tight (threshold: {NARROW_MARGIN_DAYS} days).", p.margin)
    ).otherwise(F.format_string("Margin of %.1f days is comfortable.", p.margin)))


DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("physical_impossibility", 1, physical_impossibility, ("travel",)),
    Rule("biological_plausibility", 2, biological_plausibility, ("year", "birth", "born")),
    Rule("AgeConsistencyRule", 3, age_consistency, ("year", "birth")),
    Rule("GenderPlausibilityRule", 4, gender_plausibility, ("given",)),
    Rule("narrow_margin", 5, narrow_margin, ("travel",)),
)
_registered: list[Rule] = list(DEFAULT_RULES)


def register_rule(name: str, order: int, check: Callable[[Pair], Column], uses: Sequence[str] | None = None) -> Rule:
    """Add a rule to the default chain; ``order`` places it, ``uses`` (of USES) says what it looks at."""
    rule = Rule(name, order, check, None if uses is None else tuple(uses))
    _registered.append(rule)
    return rule


def unregister_rule(rule: Rule) -> None:
    _registered.remove(rule)


def active_rules() -> list[Rule]:
    return sorted(_registered, key=lambda r: r.order)


#: What the rules look up for a record, as columns; of pairs ``from_*`` and ``to_*``.
FACTS = ("fact_gender", "fact_born", "fact_lat", "fact_lon")


def side_facts(records: DataFrame, cities: DataFrame | None = None, genders: Mapping[str, str] | DataFrame | None = None) -> DataFrame:
    """``records`` with FACTS: gender, the birth year of the id, and coordinates, looked up once per record instead of once per pair."""
    out = geocode(records, "location", prefix="_", cities=cities).withColumnsRenamed({"_geo_lat": "fact_lat", "_geo_lon": "fact_lon"})
    if isinstance(genders, DataFrame):
        from kindred.operators.dimensions import with_gender
        out = with_gender(out, "given_name", genders, "fact_gender")
    else:
        out = out.withColumn("fact_gender", infer_gender(F.col("given_name"), genders))
    return out.withColumn("fact_born", birth_year_from_id(F.col("record_id")))


_OPTIONAL = {"month": "int", "birth": "int"}


def _pair_columns(df: DataFrame) -> Pair:
    def anchor(side: str) -> Anchor:
        get = lambda f: (F.col(f"{side}_{f}") if f"{side}_{f}" in df.columns
                         else F.lit(None).cast(_OPTIONAL[f]))
        return Anchor(*[get(f) if f in _OPTIONAL else F.col(f"{side}_{f}")
                        for f in ("id", "given", "location", "year", "month", "birth")],
                      gender=F.col(f"_{side}_gender"), born=F.col(f"_{side}_born"))
    return Pair(anchor("from"), anchor("to"), F.col("travel_days"),
                F.col("available_days"), F.col("transit_mode"))


def _rule_columns(df: DataFrame, chain: Sequence[Rule], reasons: bool,
                  genders: Mapping[str, str] | DataFrame | None) -> tuple[DataFrame, list[Column]]:
    """Add what each rule of the chain says, as ``_rule{i}_{field}``; also a struct of that per rule."""
    fields = ["triggered", "implausible", "penalty"] + (["reason"] if reasons else [])
    pair = _pair_columns(df)
    if f"from_{FACTS[0]}" in df.columns:
        df = df.withColumns({f"_{side}_{c}": F.col(f"{side}_fact_{c}") for side in ("from", "to") for c in ("gender", "born")})
    else:
        if isinstance(genders, DataFrame):
            from kindred.operators.dimensions import with_gender
            for side in ("from", "to"):
                df = with_gender(df, f"{side}_given", genders, f"_{side}_gender")
        else:
            df = staged(df, {f"_{side}_gender": infer_gender(F.col(f"{side}_given"), genders)
                             for side in ("from", "to")})
        df = staged(df, {f"_{side}_born": birth_year_from_id(F.col(f"{side}_id")) for side in ("from", "to")})
    # one small step per rule: a single large one is too long a method for the JIT
    for i, rule in enumerate(chain):
        result = rule.check(pair)
        df = staged(df, {f"_rule{i}_{f}": result[f] for f in fields})
    df = df.drop("_from_gender", "_to_gender", "_from_born", "_to_born")
    return df, [F.struct(F.lit(rule.name).alias("rule_name"), *[F.col(f"_rule{i}_{f}").alias(f) for f in fields])
                for i, rule in enumerate(chain)]


def evaluate_rules(df: DataFrame, rules: Sequence[Rule] | None = None, reasons: bool = True,
                   genders: Mapping[str, str] | DataFrame | None = None) -> DataFrame:
    """Run the chain on a pair table that already has travel and available days.

    Adds ``rule_results`` (array of structs, one per rule, in order). Without
    ``reasons`` the texts are never built.
    """
    chain = active_rules() if rules is None else sorted(rules, key=lambda r: r.order)
    kept = df.columns
    df, steps = _rule_columns(df, chain, reasons, genders)
    return df.select(*kept, F.array(*steps).alias("rule_results"))


#: Rules up to which the names of the triggered ones come from a table of all their subsets.
SUBSETS = 8


def _triggered_names(names: Sequence[str], hits: Sequence[Column]) -> Column:
    """Array of the names whose hit is true, in order."""
    empty = F.array().cast("array<string>")
    part = lambda chosen: F.array(*[F.lit(n) for n in chosen]) if chosen else empty
    out = None
    for at in range(0, len(names), SUBSETS):
        some = names[at:at + SUBSETS]
        table = F.array(*[part([n for i, n in enumerate(some) if mask >> i & 1]) for mask in range(1 << len(some))])
        mask = sum((F.when(hit, 1 << i).otherwise(0) for i, hit in enumerate(hits[at:at + SUBSETS])), F.lit(1))
        found = F.element_at(table, mask)
        out = found if out is None else F.concat(out, found)
    return empty if out is None else out


def check_pairs(pairs: DataFrame, rules: Sequence[Rule] | None = None,
                cities: DataFrame | None = None, keep_reasons: bool = False,
                genders: Mapping[str, str] | DataFrame | None = None) -> DataFrame:
    """Travel estimate and rule chain for each pair; adds the struct ``spatio``.

    ``spatio``: plausible, travel_days, available_days, margin, transit_mode,
    rules_triggered (array), confidence_adjustment (0..50), rule_penalties (map of
    the triggered rules). With ``keep_reasons`` the column ``rule_results`` stays.
    Everything is a projection: no shuffle unless ``cities`` or ``genders`` is a table. They
    replace the built-in ones; ``genders`` maps lower-case given names or is a DataFrame (name, gender).
    Pairs that come with ``available_days`` keep theirs; those that come with FACTS of both sides (``side_facts``) have
    nothing looked up, and lose them here.
    """
    month = lambda side: (F.col(f"{side}_month") if f"{side}_month" in pairs.columns
                          else F.lit(None).cast("int"))
    kept = [c for c in pairs.columns if c not in {f"{side}_{c}" for side in ("from", "to") for c in FACTS}]
    df = transit_estimate(pairs, cities)
    if "available_days" not in kept:
        df = df.withColumn("available_days", available_days(F.col("from_year"), month("from"), F.col("to_year"), month("to")))
    chain = active_rules() if rules is None else sorted(rules, key=lambda r: r.order)
    df, steps = _rule_columns(df, chain, keep_reasons, genders)
    # no lambda over the results: those are not compiled
    of = lambda f: [F.col(f"_rule{i}_{f}") for i in range(len(chain))]
    hits = [F.coalesce(c, F.lit(False)) for c in of("triggered")]
    names = _triggered_names([r.name for r in chain], hits)
    none = F.array().cast("array<int>")
    points = [F.when(hit, F.array(c)).otherwise(none) for c, hit in zip(of("penalty"), hits, strict=True)]
    spatio = F.struct(
        (~reduce(or_, of("implausible"), F.lit(False))).alias("plausible"),
        F.col("travel_days"),
        F.col("available_days"),
        (F.col("available_days") - F.col("travel_days")).alias("margin"),
        F.col("transit_mode"),
        names.alias("rules_triggered"),
        F.least(F.lit(MAX_ADJUSTMENT), sum(
            (F.when(hit, c).otherwise(0) for c, hit in zip(of("penalty"), hits, strict=True)), F.lit(0))
                ).alias("confidence_adjustment"),
        F.map_from_arrays(names, F.concat(none, *points)).alias("rule_penalties"),
    )
    if keep_reasons:
        df = df.withColumn("rule_results", F.array(*steps))
    out = [*kept, spatio.alias("spatio")] + (["rule_results"] if keep_reasons else [])
    return df.select(*out)
