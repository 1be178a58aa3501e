
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import stable_id
from plumbline.operators.aggregates import describe
from plumbline.operators.joins import null_safe
from plumbline.operators.running import exact_percentiles
from plumbline.session import settled

#: domain, repetitions, transform, family, strength, unit (fixed values of the preregistered protocol's shape)
PLAN = "domain string, repeat_count int, transform_id string, family string, signed_strength double, unit string"


# X08
def trial_plan(protocol: DataFrame, repeated: str = "numerical_repeatability") -> DataFrame:
    """One row per trial of a protocol (columns of PLAN): transforms of the repeated domain once per repetition.

    trial_id, repeat_index and a hash of the whole specification, by which a resumed run finds what is done.
    """
    times = F.when(F.col("domain") == repeated, F.greatest(F.col("repeat_count"), F.lit(1))).otherwise(F.lit(1))
    rows = protocol.withColumn("__times", times).withColumn("repeat_index", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    name = F.when(F.col("__times") > 1, F.concat("transform_id", F.lit("__repeat_"), F.lpad(F.col("repeat_index").cast("string"), 2, "0"))).otherwise(F.col("transform_id"))
    rows = rows.withColumn("trial_id", name)
    return rows.select("domain", "trial_id", "transform_id", "family", "signed_strength", "unit", "repeat_index", stable_id("trial_", "domain", "trial_id", "transform_id", "family", "signed_strength", "unit", "repeat_index").alias("spec"))


# A25
def trial_summary(trials: DataFrame, keys: Sequence[str], family: str, residual: str) -> DataFrame:
    """Descriptors of the residuals per key and per key and family; family null is the whole key."""
    kind = F.coalesce(F.nullif(F.trim(F.col(family)), F.lit("")), F.lit("unclassified"))
    rows = trials.select(*keys, F.col(residual).alias("__r"), F.explode(F.array(F.struct(F.lit("family").alias("level"), kind.alias("family")), F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias("family")))).alias("__s"))
    return describe(rows.select(*keys, "__r", "__s.*"), [*keys, "level", "family"], "__r", extra=[F.count("*").alias("trials")])


def chain_transitions(trials: DataFrame, keys: Sequence[str], baseline: str, trial: str) -> DataFrame:
    """keys, assessed (both signatures there) and transitions (they differ; null where none was assessed)."""
    there = (F.coalesce(F.trim(F.col(baseline)), F.lit("")) != "") & (F.coalesce(F.trim(F.col(trial)), F.lit("")) != "")
    changed = F.count_if(there & (F.trim(F.col(baseline)) != F.trim(F.col(trial))))
    return trials.groupBy(*keys).agg(F.count_if(there).alias("assessed"), F.when(F.count_if(there) > 0, changed).alias("transitions"))


def diagnostics_summary(trials: DataFrame, keys: Sequence[str], diagnostics: str) -> DataFrame:
    """keys, name and descriptor of each entry of a map of diagnostics."""
    long = trials.select(*keys, F.explode(diagnostics).alias("name", "__v"))
    return describe(long.withColumnRenamed("__v", "__d"), [*keys, "name"], "__d")


# A26
def cohort_summary(trials: DataFrame, source: str, family: str, residual: str, unit: Column | None = None) -> DataFrame:
    """Across sources: descriptors of the sources' medians, maxima and spreads, per family; two aggregations."""
    units = [F.count_distinct("__unit").alias("s_units")] if unit is not None else []
    slim = trials.select(source, family, residual, *([unit.alias("__unit")] if units else []))
    per_source = settled(describe(slim, [source, family], residual, "s_", units), "sources")
    extra = [F.count("*").alias("sources"), F.sum("s_n").alias("values")]
    if unit is not None:
        extra.append((F.max("s_units") <= 1).alias("unit_consistent"))
    out = None
    for measure in ("median", "max", "spread"):
        own = describe(per_source.select(family, "s_n", f"s_{measure}", *["s_units"] * bool(units)), [family], f"s_{measure}", f"{measure}_", extra if out is None else ())
        out = own if out is None else null_safe(out, own, [family])
    return out


# A27, A28
def component_quantiles(df: DataFrame, keys: Sequence[str], name: str, value: str, percents: Sequence[float] = (5, 25, 50, 75, 95)) -> DataFrame:
    """keys, name, kind (signed or absolute) and the percentiles of a component's values."""
    both = df.select(*keys, F.col(name).alias("name"), F.explode(F.array(F.struct(F.lit("signed").alias("kind"), F.col(value).cast("double").alias("v")), F.struct(F.lit("absolute").alias("kind"), F.abs(F.col(value)).cast("double").alias("v")))).alias("__x"))
    long = both.select(*keys, "name", F.col("__x.kind").alias("kind"), F.col("__x.v").alias("v"))
    got = exact_percentiles(long, [*keys, "name", "kind"], "v", percents)
    return got.groupBy(*keys, "name", "kind", "n").agg(*[F.max(F.when(F.col("pct") == float(p), F.col("value"))).alias(f"p{p:g}") for p in percents])


# A29
def quantiles_across(df: DataFrame, source: str, keys: Sequence[str], value: str, percent: float = 50) -> DataFrame:
    """Descriptors across sources of each source's percentile."""
    rows = settled(df, "values", [source, *keys, value])
    per = exact_percentiles(rows, [source, *keys], value, [percent]).select(source, *keys, F.col("value").alias("__p"))
    everyone = null_safe(rows.select(source, *keys).distinct(), per, [source, *keys], "left")
    return describe(everyone, keys, "__p", extra=[F.count("*").alias("sources")])


# A49
def availability(trials: DataFrame, keys: Sequence[str], residual: str) -> DataFrame:
    """keys, trials, available, share of trials with a finite residual."""
    fine = F.count_if(F.coalesce(~F.isnan(residual) & (F.abs(residual) != float("inf")), F.lit(False)))
    return trials.groupBy(*keys).agg(F.count("*").alias("trials"), fine.alias("available"), (fine / F.count("*")).alias("share"))


# M32
def with_every_domain(summary: DataFrame, domains: Sequence[str], spark: SparkSession) -> DataFrame:
    """The summary with a row for each domain, NOT_MEASURED where there were no trials."""
    wanted = spark.createDataFrame([(d,) for d in domains], "domain string")
    return wanted.join(summary, "domain", "left").withColumn("state", F.when(F.coalesce(F.col("trials"), F.lit(0)) > 0, "OBSERVED").otherwise("NOT_MEASURED"))
