
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import cosine, unit
from plumbline.operators.aggregates import robust_scale, weighted_mean
from plumbline.session import settled


# A15
def centroids(df: DataFrame, key: str, vector: str, weight: Column | None = None, dims: int | None = None) -> DataFrame:
    """key, centroid: the unit vector of the weighted sum of the rows' unit vectors.

    With dims known each coordinate is one partial sum, so a group of any size costs one row per task; otherwise
    positions are exploded.
    """
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(key, unit(vector).alias("__u"), w.alias("__w")).filter(F.col("__u").isNotNull() & (F.col("__w") > 0))
    if dims:
        sums = rows.groupBy(key).agg(*[F.sum(F.try_element_at("__u", F.lit(i + 1)) * F.col("__w")).alias(f"__{i}") for i in range(dims)])
        return sums.select(key, unit(F.array(*[F.col(f"__{i}") for i in range(dims)])).alias("centroid"))
    long = rows.select(key, "__w", F.posexplode("__u").alias("__p", "__x")).groupBy(key, "__p").agg(F.sum(F.col("__x") * F.col("__w")).alias("__s"))
    return long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__p", "__s"))).alias("__l")).select(key, unit(F.transform("__l", lambda s: s["__s"])).alias("centroid"))


# F11, W07
def similarity_to_centroid(df: DataFrame, key: str, row_id: str, vector: str, dims: int | None = None) -> DataFrame:
    """key, row_id, similarity."""
    return df.join(centroids(df, key, vector, dims=dims), key).select(key, row_id, cosine(vector, "centroid").alias("similarity"))


# W07
def centroid_outliers(similarities: DataFrame, key: str, limit: float = 2.8, floor: float = 0.74) -> DataFrame:
    """Rows with z, max(0, median - similarity) / max(0.01, 1.4826 mad), and outlier (z at the limit or below the floor)."""
    similarities = settled(similarities, "similarities")
    scale = robust_scale(similarities, [key], "similarity", 0.01)
    rows = similarities.join(scale, key)
    z = F.greatest(F.lit(0.0), (F.col("centre") - F.col("similarity")) / F.col("scale"))
    return rows.withColumn("z", z).withColumn("outlier", (F.col("z") >= limit) | (F.col("similarity") < floor)).drop("centre", "mad", "scale")


# J09
def pairwise_medians(df: DataFrame, key: str, row_id: str, vector: str, block: int = 1024) -> DataFrame:
    """key, pairs, median: the median cosine of all pairs in each group, by blocks instead of a self-join of rows.

    The rows of a group are packed into blocks of bounded size, and each pair of blocks is one task's matrix product
    whose similarities are counted in bins of 1e-5; the median is interpolated within its bin, so its error is below
    1e-5 and nothing but counts is shuffled. The pairs are the operator's meaning here: n * (n - 1) / 2 per group.
    """
    bins = 200_001
    rows = df.select(key, row_id, unit(vector).alias("__u")).filter(F.col("__u").isNotNull())
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks"))
    placed = rows.join(sizes, key).withColumn("__b", F.pmod(F.xxhash64(row_id), F.col("__blocks")).cast("int"))
    # a row goes to each pair of blocks that its own block is part of
    pairs = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda o: F.struct(F.least(F.col("__b"), o).alias("x"), F.greatest(F.col("__b"), o).alias("y")))
    sent = placed.select(key, "__b", "__u", F.explode(pairs).alias("__p")).select(key, "__b", "__u", "__p.x", "__p.y")
    kind = df.schema[key].dataType.simpleString()

    def count(table: pa.Table) -> pa.Table:
        b, x, y = table.column("__b").to_numpy(), table.column("x")[0].as_py(), table.column("y")[0].as_py()
        width = len(table.column("__u")[0])
        u = table.column("__u").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        if x == y:
            near = (u @ u.T)[np.triu_indices(len(u), 1)]
        else:
            near = (u[b == x] @ u[b == y].T).ravel()
        at = np.clip(np.rint((near + 1) * 1e5), 0, bins - 1).astype(np.int64)
        found, n = np.unique(at, return_counts=True)
        return pa.table([pa.array([table.column(key)[0].as_py()] * len(found), table.schema.field(key).type), pa.array(found), pa.array(n)], names=[key, "bin", "n"])

    counts = sent.groupBy(key, "x", "y").applyInArrow(count, f"`{key}` {kind}, bin bigint, n bigint").groupBy(key, "bin").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("__upto", F.sum("n").over(order)).withColumn("__all", F.sum("n").over(Window.partitionBy(key)))
    low, high = F.floor((F.col("__all") - 1) / 2), F.ceil((F.col("__all") - 1) / 2)
    at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("bin")))
    return run.groupBy(key, F.col("__all").alias("pairs")).agg(((at(low) + at(high)) / 2e5 - 1.0).alias("median"))


# A23
def cohesion(df: DataFrame, key: str, row_id: str, vector: str, weight: str, dims: int | None = None, parts: Sequence[float] = (0.7, 0.3)) -> DataFrame:
    """key, centroid_mean, pair_median, cohesion: the weighted mean of both, over what is there."""
    centre = centroids(df, key, vector, F.col(weight), dims)
    means = df.join(centre, key).groupBy(key).agg(weighted_mean(cosine(vector, "centroid"), weight).alias("centroid_mean"))
    both = means.join(pairwise_medians(df, key, row_id, vector), key, "left")
    value = F.when(F.col("median").isNull(), F.col("centroid_mean")).otherwise(parts[0] * F.col("centroid_mean") + parts[1] * F.col("median"))
    return both.select(key, "centroid_mean", F.col("median").alias("pair_median"), value.alias("cohesion"))


# A46, R27
def drift(df: DataFrame, row_id: str, vector: str, bank: DataFrame, key: str, cuts: Sequence[tuple[float, str]] = ((0.9, "STEADY"), (0.75, "WATCH"))) -> DataFrame:
    """Rows against the centroid of their key in a bank of centroids: similarity and the flag of the first cut reached."""
    rows = df.join(bank.select(key, "centroid"), key, "left").withColumn("similarity", cosine(vector, "centroid"))
    flag = F.when(F.col("similarity").isNull(), "UNKNOWN")
    for cut, name in cuts:
        flag = flag.when(F.col("similarity") >= cut, name)
    return rows.select(key, row_id, "similarity", flag.otherwise("DRIFT").alias("flag"))
