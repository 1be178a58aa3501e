
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import base_name, path_key


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi join in which null equals null; the left keys are kept once."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


# J01, S10
def last_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Of rows with equal keys the one that came last; the rank filter is applied before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(ordinal).desc())
    return df.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def labels_with_items(labels: DataFrame, items: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Every label with its item, the last one delivered; items' columns are null where there is none."""
    return labels.join(last_wins(items, keys, ordinal), list(keys), "left")


# J02
def missing(labels: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labels.join(items.select(*keys).distinct(), list(keys), "left_anti")


# J03
def resolve_by_path_or_name(rows: DataFrame, row_path: str, entries: DataFrame, entry_path: str, ordinal: str) -> DataFrame:
    """rows with entry (struct) and matched_by: by the normalised path (the last entry wins), else by a base name that
    only one entry has. A hot name cannot blow up, as names with several entries drop out before the join."""
    keyed = entries.withColumn("__path", path_key(entry_path)).withColumn("__name", base_name(entry_path))
    body = F.struct(*[F.col(c) for c in entries.columns])
    by_path = last_wins(keyed.filter("__path IS NOT NULL"), ["__path"], ordinal).select("__path", body.alias("__by_path"))
    # one entry per name: min and max ordinals agree, found by partial aggregation
    single = keyed.filter("__name IS NOT NULL").groupBy("__name").agg(F.count("*").alias("__n"), F.max_by(body, ordinal).alias("__by_name")).filter("__n = 1").drop("__n")
    out = rows.withColumn("__path", path_key(row_path)).withColumn("__name", base_name(row_path)).join(by_path, "__path", "left").join(single, "__name", "left")
    how = F.when(F.col("__by_path").isNotNull(), "path").when(F.col("__by_name").isNotNull(), "name")
    return out.withColumn("entry", F.coalesce("__by_path", "__by_name")).withColumn("matched_by", how).drop("__path", "__name", "__by_path", "__by_name")


# J04, P18
def fill_missing(base: DataFrame, updates: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """base with blank fields filled from updates, and filled (number of fields that changed)."""
    new = updates.select(*keys, *[F.col(f).alias(f"__new_{f}") for f in fields])
    both = base.join(new, list(keys), "left")
    blank = {f: F.coalesce(F.trim(F.col(f)), F.lit("")) == "" for f in fields}
    given = {f: F.coalesce(F.trim(F.col(f"__new_{f}")), F.lit("")) != "" for f in fields}
    changed = reduce(lambda a, b: a + b, [(blank[f] & given[f]).cast("int") for f in fields])
    both = both.withColumn("filled", changed)
    values = {f: F.when(blank[f] & given[f], F.col(f"__new_{f}")).otherwise(F.col(f)) for f in fields}
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in base.columns], "filled")


def unmatched(updates: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Updates whose key nothing has."""
    return missing(updates, base, keys)


# J08
def against_references(rows: DataFrame, references: DataFrame, pool: Sequence[str], score: Column) -> DataFrame:
    """Every row with every reference of its pool (an equi join on the pool's keys) and their score.

    References are a hand-kept table, so Spark broadcasts it while it is below its own threshold and shuffles beyond.
    """
    return rows.join(references, list(pool)).withColumn("score", score)


# J11
def pair_with_baseline(trials: DataFrame, baselines: DataFrame, keys: Sequence[str], hash_: str) -> DataFrame:
    """Trials with their baseline; errors says why a pair does not count."""
    renamed = baselines.select(*keys, *[F.col(c).alias(f"baseline_{c}") for c in baselines.columns if c not in keys], F.lit(True).alias("__has"))
    both = trials.join(renamed, list(keys), "left")
    errors = F.array_compact(F.array(F.when(F.col("__has").isNull(), F.lit("BASELINE_MISSING")), F.when(F.col("__has") & ~F.col(hash_).eqNullSafe(F.col(f"baseline_{hash_}")), F.lit("CONTRACT_DIFFERS"))))
    return both.withColumn("errors", errors).drop("__has")


# J12, R18
def compare_fields(reference: DataFrame, candidate: DataFrame, keys: Sequence[str], field: str, value: str) -> DataFrame:
    """keys, field, reference, candidate, state over the fields of either side."""
    left = reference.select(*keys, F.col(field), F.col(value).alias("reference"))
    right = candidate.select(*keys, F.col(field), F.col(value).alias("candidate"))
    both = left.join(right, [*keys, field], "full_outer")
    state = F.when(F.col("reference").isNull() & F.col("candidate").isNull(), "UNAVAILABLE").when(F.col("reference").isNull() | F.col("candidate").isNull(), "PARTIAL").when(F.col("reference") == F.col("candidate"), "MATCH").otherwise("MISMATCH")
    return both.withColumn("state", state)


def contract_state(fields: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, state of the whole contract: a conflict outweighs missing fields, these outweigh matches."""
    counts = fields.groupBy(*keys).agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("MATCH", "PARTIAL", "MISMATCH", "UNAVAILABLE")])
    state = F.when(F.col("mismatch") > 0, "MISMATCH").when((F.col("match") == 0) & (F.col("partial") == 0), "UNAVAILABLE").when((F.col("partial") > 0) | (F.col("unavailable") > 0), "PARTIAL_MATCH").otherwise("MATCH")
    return counts.withColumn("contract_state", state)


# J16, J18, S17
def first_existing(rows: DataFrame, candidates: Column, known: DataFrame, known_key: str, row_id: str, name: str = "resolved") -> DataFrame:
    """rows with the first of their candidate keys (an array, in order) that is known; null where none is."""
    asked = rows.select(row_id, F.posexplode(candidates).alias("__place", known_key))
    hit = asked.join(known.select(known_key).distinct(), known_key).groupBy(row_id).agg(F.min_by(known_key, "__place").alias(name))
    return rows.join(hit, row_id, "left")


# J14
def unique_stem_pairs(left: DataFrame, left_stem: str, right: DataFrame, right_stem: str) -> DataFrame:
    """Pairs whose stem is unique on both sides."""

    def once(df: DataFrame, stem: str, name: str) -> DataFrame:
        body = F.struct(*[F.col(c) for c in df.columns])
        return df.groupBy(F.col(stem).alias("stem")).agg(F.count("*").alias("__n"), F.first(body).alias(name)).filter("__n = 1").drop("__n")

    return once(left, left_stem, "left").join(once(right, right_stem, "right"), "stem")


# P08, P09
def with_fallback_levels(df: DataFrame, keys: Sequence[str], level: Column) -> DataFrame:
    """Of each group the rows of its lowest level; rows of null level never. The level of a group is a partial minimum,
    joined back, so no window gathers a group."""
    levelled = df.withColumn("level", level).filter("level IS NOT NULL")
    least = levelled.groupBy(*keys).agg(F.min("level").alias("__least"))
    return levelled.join(least, list(keys)).filter("level = __least").drop("__least")


# U07
def union_unless_empty(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """first, and second's rows of the keys that first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


# K08, K09, K10
def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key, the one of the highest version; of equal versions the change."""
    both = current.withColumn("__change", F.lit(0)).unionByName(changes.withColumn("__change", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.col("__change").desc())
    return both.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn", "__change")


# §2.11 (a)
def unfinished(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The planned units of work that no finished one matches: what a resumed run still has to do."""
    return missing(plan, done, keys)


# §2.11 (b)
def until_first_failure(df: DataFrame, keys: Sequence[str], ordinal: str, failed: Column) -> DataFrame:
    """The rows up to and with the first failed one of each group."""
    first = df.filter(failed).groupBy(*keys).agg(F.min(ordinal).alias("__stop"))
    return df.join(first, list(keys), "left").filter(F.col("__stop").isNull() | (F.col(ordinal) <= F.col("__stop"))).drop("__stop")
