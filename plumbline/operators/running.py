"""Running totals, ranks and exact percentiles of groups of any size.

A window partitioned by a key sorts the whole group in one task. Here the rows are written to the shared folder first, as
a range partitioning reads its input twice. Where the whole table has no more rows than one task may hold, a window does
the rest. Otherwise the rows are range partitioned by key and order, so a group that holds a third of the table is cut
into as many parts as its share deserves; every part adds up its own rows, and what came before a part is a running
total over the parts, a few rows per key. The parts are written once more, so that they stay the same however often a
task is run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import null_safe
from plumbline.session import materialize, parts_for

#: Rows that one task may sort.
TASK_ROWS = 500_000


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], totals: dict[str, Column], wholes: dict[str, Column] | None = None) -> DataFrame:
    """df with, per name, the sum of a column over the rows of its group up to and with this one.

    wholes: likewise sums over the whole group. Null keys form a group. The order must tell all rows of a group apart
    for the result to be certain.
    """
    wholes = wholes or {}
    held = materialize(df.withColumns({f"__t_{n}": c for n, c in totals.items()} | {f"__w_{n}": c for n, c in wholes.items()}), "rows")
    rows, helpers = held.count(), [*[f"__t_{n}" for n in totals], *[f"__w_{n}" for n in wholes]]
    if rows <= TASK_ROWS:
        upto, group = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
        sums_ = {n: F.coalesce(F.sum(f"__t_{n}").over(upto), F.lit(0)) for n in totals} | {n: F.sum(f"__w_{n}").over(group) for n in wholes}
        return held.withColumns(sums_).drop(*helpers)
    spread = held.repartitionByRange(parts_for(df.sparkSession, rows, TASK_ROWS), *[F.col(k) for k in keys], *order)
    cut = materialize(spread.withColumn("__part", F.spark_partition_id()), "parts")
    sums = cut.groupBy(*keys, "__part").agg(*[F.sum(f"__t_{n}").alias(f"__b_{n}") for n in totals], *[F.sum(f"__w_{n}").alias(n) for n in wholes])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    sums = sums.select(*keys, "__part", *[F.coalesce(F.sum(f"__b_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in totals], *[F.sum(n).over(everything).alias(n) for n in wholes])
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = null_safe(cut, sums, [*keys, "__part"])
    for n in totals:
        out = out.withColumn(n, F.col(f"__b_{n}") + F.coalesce(F.sum(f"__t_{n}").over(inside), F.lit(0)))
    return out.drop("__part", *[f"__b_{n}" for n in totals], *helpers)


def distributed_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in its group, from 1."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")})


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float]) -> DataFrame:
    """keys, pct, n, value: percentiles by linear interpolation between the neighbouring values.

    Null and NaN values do not count; a group without values has no rows. Equal values are counted together before
    anything is sorted, so what is shuffled is one row per distinct value and task.
    """
    fine = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counts = fine.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    run = running_totals(counts, keys, [F.col("__v")], {"__upto": F.col("__c")}, {"n": F.col("__c")})
    asked = run.withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    place = (F.col("n") - 1) * F.col("pct") / 100.0
    # the two neighbours of a place are among the rows whose counts reach it; others add nothing to the shuffle
    holds = lambda rank: (F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank)
    near = asked.filter(holds(F.floor(place)) | holds(F.ceil(place)))
    low, high = F.min("__v"), F.max("__v")
    return near.groupBy(*keys, "pct", "n").agg((low + (high - low) * ((F.col("n") - 1) * F.col("pct") / 100.0 - F.floor((F.col("n") - 1) * F.col("pct") / 100.0))).alias("value"))
