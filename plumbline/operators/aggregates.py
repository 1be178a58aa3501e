
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import ColumnLike, clamp, col, row_weighted_mean
from plumbline.operators.joins import null_safe
from plumbline.operators.running import exact_percentiles, running_totals
from plumbline.session import settled

STATUSES = ("PASS", "WARN", "FAIL")


def share(part: ColumnLike, whole: ColumnLike) -> Column:
    """part / whole, null where whole is not positive (never a division by zero under ANSI)."""
    return F.when(col(whole) > 0, col(part) / F.nullif(col(whole), F.lit(0)))


# A01
def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), *keys)


# A02
def count_unpivoted(df: DataFrame, columns: Sequence[str], variable: str = "module", value: str = "state") -> DataFrame:
    """Counts per column name and value of several columns, by one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c.split(".")[-1]).alias(variable), F.col(c).alias(value)) for c in columns])).alias("__r"))
    return long.groupBy(f"__r.{variable}", f"__r.{value}").agg(F.count("*").alias("n"))


# A03
def confusion(df: DataFrame, expected: str, predicted: str, weight: str) -> DataFrame:
    return df.groupBy(expected, predicted).agg(F.sum(weight).alias("weight"), F.count("*").alias("items"))


# A04
def class_metrics(cells: DataFrame, expected: str = "expected", predicted: str = "predicted", weight: str = "weight", by: Sequence[str] = ()) -> DataFrame:
    """precision (1 with no prediction), recall and f1 (0 without a denominator) per class of a confusion table."""
    one = cells.select(*by, F.explode(F.array(F.struct(F.col(expected).alias("c"), F.lit("e").alias("r")), F.struct(F.col(predicted).alias("c"), F.lit("p").alias("r")))).alias("__x"), F.col(weight).alias("__w"), (F.col(expected) == F.col(predicted)).alias("__hit"))
    sums = one.filter(F.col("__x.c").isNotNull()).groupBy(*by, F.col("__x.c").alias("class")).agg(
        F.sum(F.when((F.col("__x.r") == "p") & F.col("__hit"), F.col("__w")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(F.col("__x.r") == "p", F.col("__w")).otherwise(0.0)).alias("predicted_weight"),
        F.sum(F.when(F.col("__x.r") == "e", F.col("__w")).otherwise(0.0)).alias("expected_weight"),
    )
    scored = sums.withColumn("precision", F.coalesce(share("tp", "predicted_weight"), F.lit(1.0))).withColumn("recall", F.coalesce(share("tp", "expected_weight"), F.lit(0.0)))
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.coalesce(share(2.0 * F.col("precision") * F.col("recall"), both), F.lit(0.0)))


# A05
def overall_metrics(cells: DataFrame, safe: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, macro F1 over the classes that occur, false rate of the class safe, and the safety composite."""
    if not by:
        return overall_metrics(cells.withColumn("__whole", F.lit(0)), safe, ["__whole"]).drop("__whole")
    classes = class_metrics(cells, by=by)
    macro = classes.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.coalesce(F.max(F.when(F.col("class") == safe, F.col("precision"))), F.lit(1.0)).alias("safe_precision"))
    totals = cells.groupBy(*by).agg(
        F.sum("weight").alias("weight_sum"),
        F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("weight")).otherwise(0.0)).alias("__hit"),
        F.sum(F.when((F.col("predicted") == safe) & (F.col("expected") != safe), F.col("weight")).otherwise(0.0)).alias("__false"),
    )
    both = totals.join(macro, list(by)).withColumn("accuracy", F.coalesce(share("__hit", "weight_sum"), F.lit(0.0))).withColumn("false_rate", F.coalesce(share("__false", "weight_sum"), F.lit(0.0)))
    safety = 0.45 * F.col("macro_f1") + 0.35 * F.col("safe_precision") + 0.20 * (1.0 - F.col("false_rate"))
    return both.select(*by, "weight_sum", "accuracy", "macro_f1", "safe_precision", "false_rate", safety.alias("safety"))


# A06
def optional_accuracy(match: ColumnLike, weight: ColumnLike) -> Column:
    """Weighted share of true among not null; null where nothing was checked."""
    checked = F.sum(F.when(col(match).isNotNull(), col(weight)))
    return share(F.sum(F.when(col(match), col(weight)).otherwise(0.0)), checked)


# A07
def grouped_accuracy(df: DataFrame, sets: Sequence[Sequence[str]], match: ColumnLike, weight: ColumnLike) -> DataFrame:
    """The same measure for several groupings and the whole, in one pass of grouping sets; level names the grouping."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    level = F.lit("all")
    for s in sets:
        if s:
            level = F.when(reduce(lambda a, b: a & b, [(F.grouping(c) == (0 if c in s else 1)) for c in columns]), F.lit("+".join(s))).otherwise(level)
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(level.alias("level"), F.count("*").alias("items"), optional_accuracy(match, weight).alias("accuracy"))


# A11 (down a column)
def weighted_mean(value: ColumnLike, weight: ColumnLike) -> Column:
    """Aggregate: nulls skipped, weights renormalised, null without weight."""
    v, w = col(value), col(weight)
    return share(F.sum(F.when(v.isNotNull(), v * w)), F.sum(F.when(v.isNotNull(), w)))


# A14
def geometric_mean(value: ColumnLike, weight: ColumnLike | None = None, floor: float = 1e-4) -> Column:
    logs = F.ln(clamp(value, floor, 1.0))
    return F.exp(weighted_mean(logs, F.lit(1.0) if weight is None else weight))


# A17
def stability(value: ColumnLike, scale: float, single: float = 0.58) -> Column:
    """1 less the population deviation over scale, held within [0, 1]; single for one value, null for none."""
    n = F.count(col(value))
    return F.when(n == 1, F.lit(single)).when(n > 1, clamp(1.0 - F.stddev_pop(col(value)) / max(1e-6, scale), 0.0, 1.0))


# A16, W06
def robust_scale(df: DataFrame, keys: Sequence[str], value: str, least: float = 0.02) -> DataFrame:
    """keys, centre (median), mad, scale = max(least, 1.4826 mad). Two exact medians, no window over a whole group."""
    df = settled(df, "values", [*keys, value])
    centres = exact_percentiles(df, keys, value, [50]).select(*keys, F.col("value").alias("centre"))
    gaps = null_safe(df.select(*keys, F.col(value).alias("__v")), centres, keys).withColumn("__gap", F.abs(F.col("__v") - F.col("centre")))
    mads = exact_percentiles(gaps, [*keys, "centre"], "__gap", [50])
    return mads.select(*keys, "centre", F.col("value").alias("mad"), F.greatest(F.lit(least), 1.4826 * F.col("value")).alias("scale"))


def robust_outliers(df: DataFrame, keys: Sequence[str], value: str, limit: float = 3.2, least: float = 0.02) -> DataFrame:
    """Rows whose robust z, |x - median| / scale, reaches the limit, with z."""
    scaled = null_safe(df, robust_scale(df, keys, value, least), keys)
    return scaled.withColumn("z", F.abs(F.col(value) - F.col("centre")) / F.col("scale")).filter(F.col("z") >= limit)


# A20
def set_coverage(values: ColumnLike, expected: Sequence[str]) -> Column:
    """Aggregate: share of the expected names that occur."""
    wanted = F.array(*[F.lit(x) for x in expected])
    return F.size(F.array_intersect(F.collect_set(F.when(col(values).isin(*expected), col(values))), wanted)) / float(max(1, len(expected)))


# A21, A22
def dominant(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, dominant value (most rows, then the smaller) and its share of the rows with a value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*keys).orderBy(F.col("__n").desc(), F.col(value))
    ranked = counts.withColumn("__rn", F.row_number().over(order)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    return ranked.filter("__rn = 1").select(*keys, F.col(value).alias("dominant"), (F.col("__n") / F.col("__all")).alias("share"))


# A24
def describe(df: DataFrame, keys: Sequence[str], value: ColumnLike, prefix: str = "", extra: Sequence[Column] = ()) -> DataFrame:
    """keys, extra aggregates, and n, min, median, max, spread of the finite values; all but n null without one.

    The median is counted over distinct values in parts of the groups, so that no task holds a hot group's values.
    """
    c = col(value)
    fine = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    rows = settled(df.withColumn("__v", fine), "described")
    v = F.col("__v")
    flat = rows.groupBy(*keys).agg(*extra, F.count(v).alias(f"{prefix}n"), F.min(v).alias(f"{prefix}min"), F.max(v).alias(f"{prefix}max"), (F.max(v) - F.min(v)).alias(f"{prefix}spread"))
    medians = exact_percentiles(rows, keys, "__v", [50]).select(*keys, F.col("value").alias(f"{prefix}median"))
    return null_safe(flat, medians, keys, "left")


# A30, A31
def guarded_percentiles(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float], least: int = 1) -> DataFrame:
    """keys, n and the interpolated percentiles; null below least values. Counted in parts of the groups, as in describe."""
    rows = settled(df, "calibrated", [*keys, value])
    got = exact_percentiles(rows, keys, value, percents).filter(F.col("n") >= least)
    named = [F.max(F.when(F.col("pct") == float(p), F.col("value"))).alias(f"p{p:g}".replace(".", "_")) for p in percents]
    return null_safe(rows.groupBy(*keys).agg(F.count(value).alias("n")), got.groupBy(*keys).agg(*named), keys, "left")


# A32
def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, quantiles: Sequence[float]) -> DataFrame:
    """keys, q, value: interpolation on the cumulative weight, held at the first and last value.

    Weights of equal values are added before the window, so a hot key shuffles its distinct values only.
    """
    fine = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(weight) > 0)).groupBy(*keys, F.col(value).alias("__v")).agg(F.sum(weight).alias("__w"))
    run = running_totals(fine, keys, [F.col("__v")], {"__c": F.col("__w")}, {"__total": F.col("__w")})
    asked = run.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))).withColumn("__t", F.col("q") * F.col("__total"))
    # of the values below the target the last, of those that reach it the first: two bounded aggregates, no window
    last = F.max(F.when(F.col("__c") < F.col("__t"), F.struct(F.col("__c").alias("c"), F.col("__v").alias("v"))))
    first = F.min(F.when(F.col("__c") >= F.col("__t"), F.struct(F.col("__c").alias("c"), F.col("__v").alias("v"))))
    ends = asked.groupBy(*keys, "q", "__t").agg(last.alias("a"), first.alias("b"))
    between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("__t") - F.col("a.c")) / (F.col("b.c") - F.col("a.c"))
    # beyond the last cumulative weight, by rounding only, the last value holds
    return ends.select(*keys, "q", F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(between).alias("value"))


# A33
def correlation(x: ColumnLike, y: ColumnLike) -> Column:
    """Pearson over the pairs without null; null for fewer than two pairs or no variance (corr would raise)."""
    both = col(x).isNotNull() & col(y).isNotNull()
    px, py = F.when(both, col(x)), F.when(both, col(y))
    spread = F.stddev_pop(px) * F.stddev_pop(py)
    return F.when((F.count(px) >= 2) & (spread > 0), F.covar_pop(px, py) / F.nullif(spread, F.lit(0.0)))


# A34
def entropy(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, classes, entropy (bits), purity = 1 - entropy / log2(classes) (1 for one class)."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"), F.count("*").alias("classes"), F.sum(F.col("__n") * F.log2("__n")).alias("__s"))
    bits = F.greatest(F.log2("__all") - F.col("__s") / F.col("__all"), F.lit(0.0))
    return totals.select(*keys, "classes", bits.alias("entropy"), F.when(F.col("classes") > 1, 1.0 - bits / F.nullif(F.log2("classes"), F.lit(0.0))).otherwise(1.0).alias("purity"))


# A36, A37
def coverage(predicate: Column) -> Column:
    """Aggregate: share of rows for which the predicate holds; null counts as a miss, 0 without rows."""
    return F.coalesce(F.avg(F.when(predicate, 1.0).otherwise(0.0)), F.lit(0.0))


def field_coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, present, missing, coverage of text fields; one pass over the rows."""
    aggregated = df.agg(F.count("*").alias("__all"), *[F.count_if(F.length(F.trim(F.col(f))) > 0).alias(f) for f in fields])
    long = aggregated.select("__all", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in fields])).alias("__x"))
    return long.select("__x.field", "__x.present", (F.col("__all") - F.col("__x.present")).alias("missing"), (F.col("__x.present") / F.greatest(F.col("__all"), F.lit(1))).alias("coverage"))


# A39, A40, P11
def reason_counts(df: DataFrame, reasons: str, drop_suffix: str = "_READY", keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """keys, reason, n: elements in upper case without blanks and ready marks; with a limit the most frequent."""
    clean = F.transform(F.col(reasons), lambda x: F.upper(F.trim(x)))
    kept = F.filter(clean, lambda x: x.isNotNull() & (x != "") & ~x.endswith(drop_suffix))
    counts = df.select(*keys, F.explode(kept).alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "reason").limit(limit) if limit else counts


# A42
def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v.lower()) for v in values])


# A43
def bucket_stats(df: DataFrame, bucket: str, value: str) -> DataFrame:
    """Statistics of each bucket and of all rows together."""
    return df.groupingSets([[F.col(bucket)], []], F.col(bucket)).agg(F.when(F.grouping(bucket) == 1, F.lit("all")).otherwise(F.col(bucket)).alias("level"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).drop(bucket)


def stats_with_fallback(stats: DataFrame, wanted: DataFrame, bucket: str) -> DataFrame:
    """For each wanted bucket its own statistics if it has rows, else those of 'all'."""
    measures = ("n", "mean", "low", "high")
    own = stats.filter("level <> 'all' AND n >= 1").select(F.col("level").alias(bucket), *[F.col(m).alias(f"__{m}") for m in measures])
    whole = stats.filter("level = 'all'").select(*measures).first()  # one row
    fell_back = F.col("__n").isNull()
    values = [F.when(fell_back, F.lit(whole[m] if whole else None)).otherwise(F.col(f"__{m}")).alias(m) for m in measures]
    return wanted.join(own, bucket, "left").select(bucket, *values, fell_back.alias("fell_back"))


# A41, M57
def axis_summary(axes: Sequence[ColumnLike]) -> Column:
    """struct(mean, least, available) of a row's axes."""
    values = F.filter(F.array(*[col(a) for a in axes]), lambda x: x.isNotNull())
    return F.struct(row_weighted_mean([(a, 1.0) for a in axes]).alias("mean"), F.array_min(values).alias("least"), F.size(values).alias("available"))
