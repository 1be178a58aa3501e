
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import clamp
from plumbline.operators.joins import null_safe
from plumbline.operators.running import distributed_rank, running_totals
from plumbline.session import materialize


def _order(score: str, tie: str, confidence: str | None = None) -> list[Column]:
    order = [F.col(score).desc_nulls_last()]
    if confidence:
        order.append(F.coalesce(F.col(confidence), F.lit(0.0)).desc())  # a missing confidence sorts as 0
    return [*order, F.col(tie).asc_nulls_last()]


# W01, W02
def rank_within(df: DataFrame, keys: Sequence[str], score: str, tie: str, confidence: str | None = None, name: str = "rank") -> DataFrame:
    """rank from 1: score downward with null last, then confidence downward, then the tie column upward.

    Ranks over parts of the groups, so that a hot group is not sorted in one task.
    """
    return distributed_rank(df, keys, _order(score, tie, confidence), name)


def first_n(df: DataFrame, keys: Sequence[str], score: str, tie: str, n: int) -> DataFrame:
    """The first n of each group; the rank filter lets every task keep n rows of a group before the shuffle."""
    return _first(df, keys, _order(score, tie), n).drop("__rank")


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= n)


def _top_two(df: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """keys, __top and __second: the scores of the first two rows of each group."""
    two = _first(df.select(*keys, score, tie), keys, _order(score, tie), 2)
    return two.groupBy(*keys).agg(F.max(F.when(F.col("__rank") == 1, F.col(score))).alias("__top"), F.max(F.when(F.col("__rank") == 2, F.col(score))).alias("__second"))


# W03
def with_gaps(df: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """rank, delta_top (own score less the first) and gap_top2 (first less second); null scores give null."""
    ranked = null_safe(rank_within(df, keys, score, tie), _top_two(df, keys, score, tie), keys)
    return ranked.withColumn("delta_top", F.col(score) - F.col("__top")).withColumn("gap_top2", F.col("__top") - F.col("__second")).drop("__top", "__second")


# W04
def review_window(gap: Column | str, cuts: Sequence[tuple[float, int]] = ((0.005, 3), (0.012, 2)), usual: int = 1) -> Column:
    """How many of the first rows to look at: more the closer the first two are."""
    c = F.col(gap) if isinstance(gap, str) else gap
    out = None
    for limit, size in cuts:
        out = (F.when if out is None else out.when)(c < limit, F.lit(size))
    return F.lit(usual) if out is None else out.otherwise(F.lit(usual))


# W05
def quota_pass(df: DataFrame, keys: Sequence[str], score: str, tie: str, status: str, fail_guard: Column, pass_guard: Column, ratio: Column | float, confidence: str | None = None, small: int = 8) -> DataFrame:
    """final status of an ordered scan with a quota, without a scan.

    A fail guard fails a row; a PASS with a pass guard is a WARN; the other PASS rows keep it while the quota lasts,
    ceil(n * ratio) per group (all n in groups below small), and are WARN beyond it. No guard depends on how much of
    the quota is used, so a running count of the eligible rows says the same as the scan.
    """
    fails, guarded = F.coalesce(fail_guard, F.lit(False)), F.coalesce(pass_guard, F.lit(False))
    eligible = F.coalesce(~fails & (F.col(status) == "PASS") & ~guarded, F.lit(False))
    rows = running_totals(df.withColumn("__eligible", eligible), keys, _order(score, tie, confidence), {"__used": F.col("__eligible").cast("long")}, {"__n": F.lit(1).cast("long")})
    share = F.lit(float(ratio)) if isinstance(ratio, (int, float)) else ratio
    quota = F.when(F.col("__n") < small, F.col("__n")).otherwise(F.greatest(F.lit(1), F.ceil(F.col("__n") * share)))
    final = F.when(fails, "FAIL").when(F.col("__eligible") & (F.col("__used") > quota), "WARN").when((F.col(status) == "PASS") & guarded, "WARN").otherwise(F.col(status))
    return rows.withColumn("final_status", final).drop("__eligible", "__n", "__used")


# W08
def rank_stability(df: DataFrame, keys: Sequence[str], score: str, tie: str, delta: float = 0.015, span: float = 0.03) -> DataFrame:
    """keys, gap, stability, band, cluster_count: how far the first is ahead, and how many are within delta of it."""
    rows = null_safe(df.select(*keys, F.col(score).alias("__s")), _top_two(df, keys, score, tie), keys)
    out = rows.groupBy(*keys, "__top", "__second").agg(F.count_if(F.col("__top") - F.col("__s") <= delta).alias("cluster_count"))
    out = out.withColumn("gap", F.when(F.col("__second").isNotNull(), F.greatest(F.lit(0.0), F.col("__top") - F.col("__second"))))
    out = out.withColumn("stability", clamp(F.col("gap") / span, 0.0, 1.0))
    band = F.when(F.col("stability").isNull(), "UNAVAILABLE").when(F.col("stability") >= 0.70, "STABLE").when(F.col("stability") >= 0.35, "CLOSE").otherwise("TIGHT")
    return out.select(*keys, "gap", "stability", band.alias("band"), "cluster_count")


# W09
def best_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per group by a composite order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


# W11
def better_of(original: Column, mirrored: Column) -> Column:
    """'mirrored' only if strictly better; the original wins ties and against null."""
    return F.when(mirrored > original, F.lit("mirrored")).when(original.isNull() & mirrored.isNotNull(), F.lit("mirrored")).otherwise(F.lit("original"))


# W12
def weakest(parts: Sequence[tuple[str, str]]) -> Column:
    """struct(value, part) of the least value; of equal ones the part named first; nulls do not count."""
    ranked = F.array(*[F.struct(F.col(c).alias("value"), F.lit(i).alias("place"), F.lit(n).alias("part")) for i, (n, c) in enumerate(parts)])
    least = F.array_min(F.filter(ranked, lambda x: x["value"].isNotNull()))
    return F.struct(least["value"].alias("value"), least["part"].alias("part"))


# W15
def largest_entries(entries: Column, n: int) -> Column:
    """The n entries of a map with the greatest absolute values, as structs; ties by key."""
    ranked = F.transform(F.map_entries(entries), lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("key"), e["value"].alias("value")))
    kept = F.slice(F.array_sort(F.filter(ranked, lambda x: x["value"].isNotNull())), 1, n)
    return F.transform(kept, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))


# W17
def groups_with_examples(df: DataFrame, keys: Sequence[str], name: str, confidence: str, n: int = 5) -> DataFrame:
    """keys, size, share and the n first names by confidence downward; a missing confidence goes first, as 1.

    The examples come from a rank filter, so no group is gathered to pick them.
    """
    order = Window.partitionBy(*keys).orderBy(F.coalesce(-F.col(confidence), F.lit(-1.0)), F.col(name))
    examples = df.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= n).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", F.col(name).alias("x")))), lambda s: s["x"]).alias("examples"))
    sizes = materialize(df.groupBy(*keys).agg(F.count("*").alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 1
    return sizes.join(examples, list(keys)).select(*keys, "size", (F.col("size") / float(total)).alias("share"), "examples")


# W18
def by_named_order(c: Column | str, names: Sequence[str]) -> Column:
    """The place of a name in a fixed order, for sorting; others last."""
    x = F.col(c) if isinstance(c, str) else c
    out = F
    for i, name in enumerate(names):
        out = out.when(x == name, F.lit(i))
    return out.otherwise(F.lit(len(names)))


# M52
def compare_top(df: DataFrame, keys: Sequence[str], score: str, tie: str, n: int = 3) -> DataFrame:
    """The first row of each group against the next ones up to rank n: keys, top, other, rank, delta."""
    ranked = _first(df, keys, _order(score, tie), n)
    # at most n rows of a group are left, on the partitioning that the ranks came with
    whole = Window.partitionBy(*keys).orderBy("__rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = ranked.withColumn("top", F.first(tie).over(whole)).withColumn("__top", F.first(score).over(whole)).filter(F.col("__rank") > 1)
    return both.select(*keys, "top", F.col(tie).alias("other"), F.col("__rank").alias("rank"), (F.col(score) - F.col("__top")).alias("delta"))
