
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.running import exact_percentiles


# M49, M51, M53, M60, M61, K02
def packets(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[str], n: int, count_by: str) -> DataFrame:
    """keys, size, counts (map of count_by) and items: the first n rows as structs of the fields.

    The rank filter bounds what is gathered per group; counts come from two partial aggregations.
    """
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rn") <= n)
    body = F.struct(*[F.col(f) for f in fields])
    items = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", body.alias("item")))), lambda s: s["item"]).alias("items"))
    counted = rows.groupBy(*keys, F.coalesce(F.col(count_by), F.lit("UNKNOWN")).alias("__k")).agg(F.count("*").alias("__c"))
    counts = counted.groupBy(*keys).agg(F.sum("__c").alias("size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__c")))).alias("counts"))
    return counts.join(items, list(keys))


# M43
def replaced_reason(reasons: Column | str, prefix: str, new: Column) -> Column:
    """The reasons without those of a prefix, and the new one at the end; null lists read as empty."""
    held = F.coalesce(F.col(reasons) if isinstance(reasons, str) else reasons, F.array().cast("array<string>"))
    kept = F.filter(held, lambda r: r.isNotNull() & ~r.startswith(prefix))
    return F.concat(kept, F.array_compact(F.array(new)))


# M36
def master_reference(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """The exact median of every feature over all rows: one row of numbers, to be used as literals."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("x.*")
    found = {r.name: r.value for r in exact_percentiles(long, ["name"], "v", [50]).collect()}  # one row per feature
    return {f: found.get(f) for f in features}


# M63, M64
def settings_frame(spark: SparkSession, settings: dict[str, object]) -> DataFrame:
    """path, value, kind: settings as rows, to be written beside a result or joined with another run's."""
    rows = [(path, None if value is None else str(value), type(value).__name__) for path, value in sorted(settings.items())]
    return spark.createDataFrame(rows, "path string, value string, kind string")


# S11
def first_path(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """The first of several paths that exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for candidate in candidates:
        path = jvm.org.apache.hadoop.fs.Path(candidate)
        if path.getFileSystem(conf).exists(path):
            return candidate
    return None


# S16, P07, P09, P10
def anchor_pools(registry: DataFrame, features: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """role, view, path and features of the usable anchors of the wanted roles; a role without any raises when it is read."""
    pools = registry.filter(F.col("role").isin(*wanted)).join(features.filter("ok"), "path")
    have = pools.groupBy("role").agg(F.count("*").alias("__n"))
    asked = registry.sparkSession.createDataFrame([(r,) for r in wanted], "role string").join(have, "role", "left")
    checked = asked.select(F.when(F.col("__n") > 0, F.col("role")).otherwise(F.raise_error(F.concat(F.lit("no usable anchor for role "), F.col("role")))).alias("role"))
    return checked.join(pools, "role")


# K13
def replay_plan(areas: DataFrame, variants: Sequence[str], priority: Column) -> DataFrame:
    """task, area, variant, priority: a task for every variant of every area."""
    out = areas.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants]))).withColumn("priority", priority)
    return out.select(F.concat_ws("__", "area", "variant").alias("task"), "area", "variant", "priority")
