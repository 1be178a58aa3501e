"""A score cutoff per source that keeps a target fraction of its rows.

Every source gets a mergeable quantile sketch (KLL, built by partial aggregation in the JVM; its rank error is bounded
by k). The sketch is asked for the two scores that bracket the target rank by several times that error. A second pass
over the rows counts, per source, the rows above the bracket and the distinct scores within it, and takes the highest
score that keeps enough. A source whose bracket misses its rank, which the bound makes very rare, is counted over all
its scores instead, so that the cutoffs are exact, ties included.

Defined results: rows with a null or unusable score belong to no source; null source keys form a source of their own; a
source without a target has no cutoff; a target of 0 or less keeps nothing, one of 1000 or more keeps all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import null_safe
from plumbline.operators.running import running_totals
from plumbline.session import materialize


#: Ranks at which a sketch is read, as parts of the whole.
GRID = 100


def source_sketches(rows: DataFrame, keys: list[str], score: str, k: int = 400) -> DataFrame:
    """keys, n and sketch, a binary that kll_sketch_merge_double combines with those of other days."""
    return rows.groupBy(*keys).agg(F.count(score).alias("n"), F.expr(f"kll_sketch_agg_double(`{score}`, {k})").alias("sketch"))


def cutoffs(rows: DataFrame, keys: list[str], score: str, targets: DataFrame, target_key: str, permille: str = "keep_permille", k: int = 400, margin: float = 0.02) -> DataFrame:
    """keys, n, permille, cutoff, kept, ties (rows at the cutoff) of every source that has a target.

    rows: usable rows only. targets: target_key (one of keys) and permille. margin: half width of the bracket in ranks
    as a share of n; at k = 400 the sketch's own error is under 0.007 of n.
    """
    rows = rows.select(*keys, F.col(score).cast("double").alias("__score"))
    sketches = source_sketches(rows, keys, "__score", k).join(targets.select(target_key, permille), target_key)
    # Spark reads a sketch at constant ranks only: read all of a grid, then pick the two that enclose the target's rank
    grid = "array(" + ", ".join(f"{i / GRID}D" for i in range(GRID + 1)) + ")"
    ranks = sketches.withColumn("__grid", F.expr(f"kll_sketch_get_quantile_double(sketch, {grid})"))
    quantile = 1.0 - F.least(F.greatest(F.col(permille), F.lit(0)), F.lit(1000)) / 1000.0
    held = lambda step: F.least(F.greatest(step, F.lit(0)), F.lit(GRID)).cast("int") + 1
    low, high = held(F.floor((quantile - margin) * GRID)), held(F.ceil((quantile + margin) * GRID))
    brackets = ranks.select(*keys, "n", permille, F.element_at("__grid", low).alias("__low"), F.element_at("__grid", high).alias("__high"))
    first = materialize(_choose(rows, brackets, keys, permille), "cutoffs")
    missed = first.filter("cutoff is null").select(*keys, "n", permille, F.lit(float("-inf")).alias("__low"), F.lit(float("inf")).alias("__high"))
    again = _choose(rows, missed, keys, permille)
    return first.filter("cutoff is not null").unionByName(again)


def _choose(rows: DataFrame, brackets: DataFrame, keys: list[str], permille: str) -> DataFrame:
    """The counting pass. cutoff is null where the bracket turns out not to hold it."""
    inside = null_safe(rows, brackets, keys).filter(F.col("__score") >= F.col("__low"))
    # all scores above the bracket share one bin, so that a source shuffles its bracket's distinct scores and one count
    above = F.lit(float("inf"))
    bin_ = F.when(F.col("__score") > F.col("__high"), above).otherwise(F.col("__score"))
    counts = inside.groupBy(*keys, "n", permille, bin_.alias("__bin")).agg(F.count("*").alias("__rows"))
    counts = running_totals(counts, keys, [F.col("__bin").desc()], {"__kept": F.col("__rows")})
    enough = 1000 * F.col("__kept") >= F.least(F.col(permille), F.lit(1000)) * F.col("n")
    choice = F.max(F.when(enough, F.struct(F.col("__bin").alias("cutoff"), F.col("__kept").alias("kept"), F.col("__rows").alias("ties"))))
    best = counts.groupBy(*keys, "n", permille).agg(choice.alias("__best"))
    # where the bin above the bracket is enough by itself, the bracket missed too
    return best.withColumn("__best", F.when(F.col("__best.cutoff") != above, F.col("__best"))).select(*keys, "n", permille, "__best.*")


def kept_rows(rows: DataFrame, cuts: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The rows at or above their source's cutoff, with all columns."""
    cut = cuts.select(*keys, F.col("cutoff").alias("__cutoff"))
    return null_safe(rows, cut, keys).filter(F.col(score).cast("double") >= F.col("__cutoff")).drop("__cutoff")
