"""

Rules that belong to one house's policy are not built in; these operators take them as columns or as small tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import ColumnLike, col


# R08, R13, R16, M24, M47
def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in the order given; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for condition, name in rules]))


# R11, R24
def gate(metrics: DataFrame, limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, failed (sorted reasons), passed of long metrics (keys, metric, value) against limits (metric, kind, bound, reason).

    kind is 'min' or 'max'. A missing value or bound skips its test.
    """
    met = metrics.join(limits, "metric")
    broken = ((F.col("kind") == "min") & (F.col("value") < F.col("bound"))) | ((F.col("kind") == "max") & (F.col("value") > F.col("bound")))
    return met.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(broken, F.col("reason")))).alias("failed")).withColumn("passed", F.size("failed") == 0)


# R14, W11
def vote(lanes: Sequence[str], votes: Sequence[tuple[str, Column, float]]) -> Column:
    """struct(lane, score, margin): every rule that holds adds its weight to a lane; the lane named first wins ties."""
    totals = []
    for lane in lanes:
        total = F.lit(0.0)
        for name, condition, weight in votes:
            if name == lane:
                total = total + F.when(F.coalesce(condition, F.lit(False)), F.lit(float(weight))).otherwise(0.0)
        totals.append(total)
    ranked = F.array_sort(F.array(*[F.struct((-t).alias("o"), F.lit(i).alias("i"), F.lit(n).alias("lane")) for i, (n, t) in enumerate(zip(lanes, totals))]))
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.struct(best["lane"].alias("lane"), (-best["o"]).alias("score"), (second["o"] - best["o"]).alias("margin"))


# P11
def suppressed(df: DataFrame, row_id: str, lane: str, reasons_: str, table: DataFrame) -> DataFrame:
    """row_id, lane, reason of the reasons that a table (lane, reason) does not suppress for their lane; lane '*' is any."""
    long = df.select(row_id, lane, F.explode(reasons_).alias("reason")).filter("reason IS NOT NULL")
    named = table.select(F.col("lane").alias("__l"), F.col("reason").alias("__r"))
    hit = (F.col("reason") == F.col("__r")) & ((F.col("__l") == "*") | (F.col("__l") == F.col(lane)))
    return long.join(named, hit, "left_anti")


# R26
def texts_for(df: DataFrame, row_id: str, reasons_: str, texts: DataFrame, limit: int) -> DataFrame:
    """row_id and advice: the distinct texts (reason, place, text) of a row's reasons in the table's order, at most limit."""
    long = df.select(row_id, F.explode(F.array_distinct(reasons_)).alias("reason")).join(texts, "reason")
    once = long.groupBy(row_id, "text").agg(F.min("place").alias("place"))
    return once.groupBy(row_id).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), 1, limit).alias("advice"))


# M01
def unmet_requirements(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], least: str = "least") -> DataFrame:
    """The required keys with the number there is, where that is below the least."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("found"))
    return wanted.join(counts, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(0))).filter(F.col("found") < F.col(least))


# M42, J17
def weighted_by_lane(df: DataFrame, lane: str, parts: dict[str, ColumnLike], weights: DataFrame) -> DataFrame:
    """df with proxy: the mean of the parts with the weights (lane, part, weight) of the row's lane, over what is there.

    The weights become one map per lane, a handful of rows, which Spark broadcasts by its own size check.
    """
    tables = weights.groupBy("lane").agg(F.map_from_entries(F.collect_list(F.struct("part", "weight"))).alias("__w")).withColumnRenamed("lane", "__lane")
    joined = df.join(tables, F.col(lane) == F.col("__lane"), "left")
    above, below = F.lit(0.0), F.lit(0.0)
    for part, c in parts.items():
        w = F.coalesce(F.try_element_at("__w", F.lit(part)), F.lit(0.0))
        above, below = above + F.coalesce(col(c) * w, F.lit(0.0)), below + F.when(col(c).isNotNull(), w).otherwise(0.0)
    return joined.withColumn("proxy", F.when(below > 0, above / F.nullif(below, F.lit(0.0)))).drop("__w", "__lane")


# M46
def pivot_metrics(long: DataFrame, keys: Sequence[str], metric: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per keys with a column per named metric: one partial aggregation, no pivot scan for the names."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col(metric) == n, F.col(value))).alias(n) for n in names])


# M50
def compare_and_set(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """old with the fields of new where there are any, and updated: whether one changed (null equals null)."""
    renamed = new.select(*keys, *[F.col(f).alias(f"__n_{f}") for f in fields], F.lit(True).alias("__has"))
    both = old.join(renamed, list(keys), "left")
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f).eqNullSafe(F.col(f"__n_{f}"))
    out = both.withColumn("updated", F.coalesce(F.col("__has"), F.lit(False)) & changed)
    values = {f: F.when(F.col("__has"), F.col(f"__n_{f}")).otherwise(F.col(f)) for f in fields}
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in old.columns], "updated")


# M55
def least_coverage(coverages: DataFrame, field: str, coverage: str) -> DataFrame:
    """field and its least coverage over several manifests."""
    return coverages.groupBy(field).agg(F.min(coverage).alias(coverage), F.count("*").alias("manifests"))


# M16
def by_precedence(df: DataFrame, keys: Sequence[str], state: str, order: Sequence[str]) -> DataFrame:
    """keys and the state that comes first in the order; unknown states come last, by name."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(state)), F.lit(0))
    ranked = F.struct(F.when(place == 0, len(order) + 1).otherwise(place).alias("o"), F.col(state).alias("s"))
    return df.filter(F.col(state).isNotNull()).groupBy(*keys).agg(F.min(ranked)["s"].alias(state))


# M21
def schema_match(a: ColumnLike, b: ColumnLike) -> Column:
    return F.when(col(a).isNull() & col(b).isNull(), "UNAVAILABLE").when(col(a).isNull() | col(b).isNull(), "ONE_SIDED").when(col(a) == col(b), "MATCH").otherwise("MISMATCH")


# M69, M70
def best_detection(df: DataFrame, keys: Sequence[str], score: Column, body: Sequence[str], tie: str) -> DataFrame:
    """keys and the columns of the detection of the greatest score; ties by the smaller tie. A bounded aggregate."""
    best = F.max_by(F.struct(*body), F.struct(score, (-F.col(tie)).alias("t")))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*")


def part_shares(df: DataFrame, keys: Sequence[str], part: str, amount: str) -> DataFrame:
    """keys, part and its share of the whole amount of the keys."""
    sums = df.groupBy(*keys, part).agg(F.sum(amount).alias("__a"))
    whole = F.sum("__a").over(Window.partitionBy(*keys))
    return sums.select(*keys, part, F.when(whole > 0, F.col("__a") / F.nullif(whole, F.lit(0.0))).alias("share"))


# R22, M26
def record_issues(df: DataFrame, row_id: str, *checks: tuple[Column, str]) -> DataFrame:
    """row_id and issue of every check that a record fails; a null check fails too."""
    return df.select(row_id, F.explode(reasons(*[(~F.coalesce(good, F.lit(False)), name) for good, name in checks])).alias("issue"))
