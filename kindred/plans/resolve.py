"""Resolution: one scored, explained answer per query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.common import is_blank
from kindred.functions.rules import Rule, check_pairs
from kindred.functions.text import (
    resolve_reasons,
    resolver_prompt,
    stage_flags,
    top_candidate_summary,
)
from kindred.operators.candidates import CANDIDATE_FIELDS, search_candidates
from kindred.operators.knn import rerank

# Fixed value: name of the four stages.
STRATEGY = "sql-search → vector-rerank → semantic-summary → spatiotemporal-validation"


def confidence(found: Column, has_year: Column, has_location: Column, top_sim: Column) -> Column:
    """Score of an answer from how much was asked and found; 0.15 .. 0.95."""
    bonus = lambda test, points: F.when(test, points).otherwise(0.0)
    score = (F.lit(0.45) + F.least(F.lit(0.3), found * 0.15)
             + bonus(has_year, 0.1) + bonus(has_location, 0.1) + bonus(top_sim >= 0.85, 0.05))
    return F.when(found == 0, 0.15).otherwise(F.least(F.lit(0.95), score))


def apply_conflict(score: Column, adjustment: Column) -> Column:
    """Take penalty points off a score, not below 0.05."""
    return F.when(adjustment > 0, F.greatest(F.lit(0.05), score - adjustment / 100.0)
                  ).otherwise(score)


def merge_ranked(candidates: DataFrame) -> DataFrame:
    """(query_id, ranked, rerank_applied): each query's candidates as one sorted array."""
    item = F.struct("new_rank", *CANDIDATE_FIELDS, "vector_similarity")
    extra = [F.max_by(c, F.when(F.col("new_rank") == 1, 1)).alias(c)
             for c in ("birth_year",) if c in candidates.columns]
    return candidates.groupBy("query_id").agg(
        F.array_sort(F.collect_list(item)).alias("ranked"),
        F.bool_or("rerank_applied").alias("rerank_applied"), *extra)


def top_candidate(ranked: Column) -> Column:
    return F.try_element_at(ranked, F.lit(1))


def resolve(queries: DataFrame, records: DataFrame, embeddings: DataFrame | None = None,
            query_vectors: DataFrame | None = None, rules: Sequence[Rule] | None = None,
            use_birth_year: bool = False, wildcards: bool = False) -> DataFrame:
    """Search, rerank, summarise and check the best candidate of every query.

    One row per query, also for queries without candidates. The plausibility check
    runs where the query has a place and a year and the best candidate has both.
    ``use_birth_year`` lets the age rules see the candidate's birth year; by default
    they only see a ``BORN:`` id.
    """
    found = search_candidates(queries, records, wildcards=wildcards)
    if embeddings is not None and query_vectors is not None:
        ordered = rerank(found, embeddings, query_vectors)
    else:
        ordered = found.withColumns({
            "vector_similarity": F.lit(None).cast("double"),
            "new_rank": F.col("rank"), "rerank_applied": F.lit(False)})
    if use_birth_year:
        ordered = ordered.join(records.select("record_id", "birth_year"), "record_id", "left")

    total = records.agg(F.count("*")).scalar()
    empty = F.array().cast(merge_ranked(ordered).schema["ranked"].dataType)
    answered = queries.join(merge_ranked(ordered), "query_id", "left").withColumns({
        "ranked": F.coalesce("ranked", empty),
        "rerank_applied": F.coalesce("rerank_applied", F.lit(False)),
        "total_candidates": total,
    }).withColumn("top", top_candidate(F.col("ranked")))

    anchors = answered.withColumns({
        "from_id": F.lit("query"), "from_given": F.col("given_name"),
        "from_location": F.col("location"), "from_year": F.col("approx_year"),
        "to_id": F.col("top.record_id"), "to_given": F.col("top.given_name"),
        "to_location": F.col("top.location"), "to_year": F.col("top.event_year"),
        **({"to_birth": F.col("birth_year")} if use_birth_year else {})})
    checkable = (F.col("top").isNotNull()
                 & ~is_blank(F.col("location")) & F.col("approx_year").isNotNull()
                 & F.col("top.event_year").isNotNull() & ~is_blank(F.col("top.location")))
    checked = check_pairs(anchors, rules).withColumn(
        "spatio", F.when(checkable, F.col("spatio")))

    asked = dict(given=F.col("given_name"), family=F.col("family_name"),
                 year=F.col("approx_year"), location=F.col("location"))
    matches = F.size("ranked")
    best_sim = F.array_max(F.transform("ranked", lambda x: x["vector_similarity"]))
    score = confidence(matches, asked["year"].isNotNull(), ~is_blank(asked["location"]), best_sim)
    state = (F.col("rerank_applied"), asked["year"], asked["location"], F.col("spatio"))
    return checked.select(
        "query_id",
        F.lit(STRATEGY).alias("strategy"),
        "total_candidates",
        matches.alias("deterministic_matches"),
        F.col("ranked").alias("ranked_candidates"),
        F.col("top"),
        F.coalesce(apply_conflict(score, F.col("spatio.confidence_adjustment")), score
                   ).alias("confidence_score"),
        resolve_reasons(F.col("total_candidates"), matches, *state).alias("reasons"),
        stage_flags(*state).alias("rules_triggered"),
        top_candidate_summary(F.col("top")).alias("semantic_summary"),
        resolver_prompt(*asked.values(), F.col("ranked")).alias("summary_prompt"),
        F.col("spatio").alias("spatio_temporal_result"))
