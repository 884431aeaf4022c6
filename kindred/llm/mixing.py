"""Mixing sources to target weights by entropy balancing.

Document rates stay as near to one copy each as the token constraints allow: of all rates
within the bounds that meet a source's target, those of least relative entropy are
min(CAP, exp(lambda * size / mean size)), with one multiplier per source. The multipliers solve
a convex dual; Newton steps on it need only sums over (source, size) counts, which are made
once. Rates are then rounded into whole copies by systematic sampling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.stores import stored
from kindred.llm.words import word_count

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: No document, and so no source, is taken more often.
CAP = 3
#: Relative distance of a source's expected words from its target at which Newton stops.
NEAR = 1e-9
ROUNDS = 60
#: Documents that are rounded together, about.
CELL = 4096
#: Starting points of the rounding that are tried for a source: TRIES over its documents, within these bounds.
TRIES, FEWEST, MOST = 2**18, 4, 256


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> source, source_size, weight, target (double).

    Sources in code point order, null last, get the weights in turn and share the sum of all sizes.
    What a target would have above ``cap`` times its source is shared again among the others.
    That ends at min(cap * size, level * weight); the level follows from running sums in the order of
    cap * size / weight, at which sources fill up. One row per source goes through one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int"))
    df = sizes.withColumn("weight", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto, all_rows = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    df = (df.withColumn("all", F.sum("source_size").over(all_rows).cast("double"))
          .withColumn("left", F.col("all") - F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
          .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
          # the first source (in filling order) that stays under its bound fixes the level for itself and all after it
          .withColumn("level", F.col("left") / F.col("open"))
          .withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
          .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), "level"))).over(all_rows)["level"]))
    return df.select("source", "source_size", "weight", F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("most")), F.col("most"))
                     .otherwise(F.col("level") * F.col("weight")).alias("target"))


def _rate(multiplier: Column, x: Column, cap: int) -> Column:
    return F.when(multiplier.isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(multiplier * x, F.lit(50.0)))))


def multipliers(histogram: DataFrame, goal: DataFrame, cap: int = CAP) -> DataFrame:
    """Solve the dual: source, mean, multiplier (null: every document the full ``cap`` times).

    ``histogram``: source, size, n. Newton's step for a source is (target - words) / slope, both sums
    over its sizes; a step that leaves the bracket found so far is replaced by its middle. A round is one aggregate of
    the histogram, written to the scratch folder; the driver sees one number per round.
    """
    goal = goal.withColumn("mean", F.col("source_size") / F.col("n_docs"))
    total = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")  # noqa: E731  exact, so that its order does not matter
    full = F.col("target") >= cap * F.col("source_size") * (1 - NEAR)
    state = stored(goal.select("source", "mean", "target", F.when(~full, F.lit(0.0)).alias("multiplier"),
                               F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("off")), "mix-dual")
    for _ in range(ROUNDS):
        if not state.where(F.col("multiplier").isNotNull() & (F.abs("off") > NEAR)).limit(1).count():
            break
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("multiplier"), x, cap)
        step = (histogram.where("size > 0").join(state.where(F.col("multiplier").isNotNull()), histogram["source"].eqNullSafe(state["source"]))
                .groupBy(state["source"], "mean", "target", "multiplier", "low", "high")
                .agg(total(F.col("n") * F.col("size") * rate).alias("words"),
                     total(F.when(rate < cap, F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("slope")))
        gap = F.col("target") - F.col("words")
        now = (step.withColumn("off", gap / F.col("target"))
               .withColumn("low", F.when(gap > 0, F.col("multiplier")).otherwise(F.col("low")))
               .withColumn("high", F.when(gap < 0, F.col("multiplier")).otherwise(F.col("high"))))
        newton = F.col("multiplier") + gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.coalesce(F.col("low"), F.lit(float("-inf")))) & (newton < F.coalesce(F.col("high"), F.lit(float("inf"))))
        middle = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        moved = now.select("source", "mean", "target", F.when(F.abs("off") <= NEAR, F.col("multiplier")).when(inside, newton).otherwise(middle).alias("multiplier"), "low", "high", "off")
        state = stored(moved.union(state.where(F.col("multiplier").isNull())), "mix-dual")
    return state.select("source", "mean", "multiplier")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` (doc_id, source, text) -> doc_id, source, size, source_size, target, rate, copies, taken.

    size: words of the text (null: 0); copies: how often the mix takes the document, 0 to ``cap``; taken:
    size * copies. Expected words meet every target; rounding moves a source by twice its largest document at
    most. Documents without words get no copy. A null source is a source; repeated rows are documents of their
    own, ties are broken by hashes, so reruns agree; an empty table gives an empty one; further columns are ignored.

    Rounding: within a source, documents of like size (quarter powers of two) are dealt into cells of about
    CELL documents by hash (equal rows by their number), so no source and no group of copies meets in one task. A document in a cell gets floor(c) - floor(c before) copies,
    where c runs over the rates; cells in turn begin where the one before ended, and the first of a source at the one of
    the points tried in [0, 1) that brings its words nearest to the target.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("salt"))
    counted = stored(rows.groupBy("doc_id", "source", "size", "salt").agg(F.count(F.lit(1)).alias("same")), "mix-sizes")
    histogram = stored(counted.groupBy("source", "size").agg(F.sum("same").alias("n")), "mix-histogram")
    # equal rows are numbered, many of them by many tasks, and each gets a salt of its own
    runs = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1, F.lit(CELL).cast("long")))).repartition("salt", "first")
    sized = runs.withColumn("nth", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + CELL, "same") - 1))).select(
        "doc_id", "source", "size", F.when(F.col("nth") == 0, F.col("salt")).otherwise(F.xxhash64("salt", "nth")).alias("salt"))
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    goal = stored(targets(sizes.select("source", "source_size"), weights, cap).alias("t").join(
        sizes.select(F.col("source").alias("s"), "n_docs"), F.col("t.source").eqNullSafe(F.col("s"))).select("t.*", "n_docs"), "mix-targets")
    dual = multipliers(histogram, goal, cap).select(F.col("source").alias("s"), "mean", "multiplier")
    plan = goal.join(dual, goal["source"].eqNullSafe(dual["s"])).drop("s")
    band = F.when(F.col("size") > 0, F.floor(4 * F.log2("size")).cast("int")).otherwise(F.lit(-1))
    cells = (histogram.groupBy("source", band.alias("band")).agg(F.ceil(F.sum("n") / CELL).alias("cells")))
    per_size = (histogram.withColumn("band", band).join(plan.select(F.col("source").alias("s"), "source_size", "target", "mean", "multiplier", "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
                .join(cells.select(F.col("source").alias("s"), F.col("band").alias("b"), "cells"), F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")))
                .select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "n_docs", "band", "cells",
                        F.when(F.col("size") > 0, _rate(F.col("multiplier"), F.col("size") / F.col("mean"), cap)).otherwise(F.lit(0.0)).alias("rate")))
    rated = (sized.join(per_size, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
             .withColumn("cell", F.pmod("salt", F.col("cells"))))
    cell = ["source", "band", "cell"]
    # rates as whole parts of 2 ** -32, so that sums do not depend on their order
    rated = rated.withColumn("part", F.round(F.col("rate") * 2**32).cast("long"))
    before = (rated.groupBy(*cell).agg(F.sum("part").alias("sum"))
              .withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("band", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select(F.col("source").alias("s"), F.col("band").alias("b"), F.col("cell").alias("c"), "before"))
    placed = rated.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")) & (F.col("cell") == F.col("c"))).drop("s", "b", "c")
    run = F.col("before") + F.sum("part").over(Window.partitionBy(*cell).orderBy("size", "salt", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = stored(placed.select("doc_id", "source", "size", "source_size", "target", "n_docs", "rate", "part", run.alias("run")), "mix-placed")

    starts = F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), (TRIES / F.col("n_docs")).cast("int")))

    def copies(start: Column) -> Column:
        begin = (start * (2.0**32 / starts)).cast("long")
        return F.shiftright(F.col("run") + begin, 32) - F.shiftright(F.col("run") - F.col("part") + begin, 32)

    tried = (placed.where("part > 0").withColumn("start", F.explode(F.sequence(F.lit(0), starts - 1)))
             .groupBy("source", "start").agg(F.abs(F.sum(F.col("size") * copies(F.col("start"))) - F.first("target")).alias("off")))
    best = tried.groupBy("source").agg(F.min(F.struct("off", "start")).alias("best")).select(F.col("source").alias("s"), F.col("best.start").alias("start"))
    taken = placed.join(best, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("copies", F.coalesce(copies(F.col("start")), F.lit(0)).cast("long"))
    return taken.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))
