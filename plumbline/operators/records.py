
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import missing, union_unless_empty


# X05
def run_repeatability(trials: DataFrame, done: DataFrame, spec: str, measure: Callable[[DataFrame], DataFrame], diagnose: Callable[[DataFrame], DataFrame], per_item: Callable[[DataFrame], DataFrame], cohort: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """An engine of four functions: trials whose spec is not done are measured and diagnosed, then all are summed up."""
    measured = diagnose(measure(missing(trials, done, [spec])))
    everything = done.unionByName(measured, allowMissingColumns=True)
    items = per_item(everything)
    return {"measured": measured, "trials": everything, "items": items, "cohort": cohort(items)}


# X11
def require(conditions: Sequence[tuple[bool, str]]) -> None:
    """Raise, with every reason, unless all conditions hold; for guards before a job is begun."""
    failed = [why for good, why in conditions if not good]
    if failed:
        raise PermissionError("; ".join(failed))


# R23, M31
def protocol_issues(rows: Sequence[dict], families: Sequence[str]) -> list[str]:
    """What is wrong with the rows of a protocol before it is run; empty for a good one."""
    issues, seen = [], set()
    for i, row in enumerate(rows):
        name = str(row.get("transform_id") or "").strip()
        if not name:
            issues.append(f"TRANSFORM_WITHOUT_ID:{i}")
        if (row.get("domain"), name) in seen:
            issues.append(f"TRANSFORM_REPEATED:{name}")
        seen.add((row.get("domain"), name))
        if row.get("family") not in families:
            issues.append(f"FAMILY_UNKNOWN:{name}")
        if not isinstance(row.get("repeat_count"), int) or row["repeat_count"] < 1:
            issues.append(f"REPEAT_COUNT_INVALID:{name}")
    return issues


# M22, M23
def shadow_records(items: DataFrame, anchors: DataFrame, keys: Sequence[str], residual: Column, contract: str) -> DataFrame:
    """Items with their anchor and residual; it is withheld, with the reason, where there is none or contracts differ.

    residual refers to the anchor's columns as anchor_<name>.
    """
    held = anchors.select(*keys, *[F.col(c).alias(f"anchor_{c}") for c in anchors.columns if c not in keys], F.lit(True).alias("__has"))
    both = items.join(held, list(keys), "left")
    why = F.when(F.col("__has").isNull(), "ANCHOR_MISSING").when(~F.col(contract).eqNullSafe(F.col(f"anchor_{contract}")), "CONTRACT_DIFFERS").when(residual.isNull(), "NOT_MEASURED")
    return both.withColumn("withheld", why).withColumn("residual", F.when(why.isNull(), residual)).drop("__has")


# M56
def review_rows(first: DataFrame, fallback: DataFrame, keys: Sequence[str], image: str, rank: str) -> DataFrame:
    """Review rows of a run, or of another source where it has none; each image once; a missing rank sorts as 999999."""
    rows = union_unless_empty(first, fallback, keys)
    once = rows.groupBy(*keys, image).agg(F.min(F.coalesce(F.col(rank), F.lit(999_999))).alias(rank))
    return once.orderBy(*keys, rank, image)


# M58
def blockers(**failed: DataFrame) -> DataFrame:
    """kind, name of everything that blocks: the union of frames with a column name."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col("name").cast("string").alias("name")) for kind, df in failed.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


# M62
def comparison_state(runs: DataFrame, comparisons: DataFrame, run: str, root: str) -> DataFrame:
    """runs with applied: whether a comparison of the run was made from the same root; null where there is none."""
    held = comparisons.select(run, F.col(root).alias("__root"))
    return runs.join(held, run, "left").withColumn("applied", F.when(F.col("__root").isNotNull(), F.col("__root").eqNullSafe(F.col(root)))).drop("__root")


# M66
def registry_snapshot(registry: DataFrame, files: DataFrame) -> DataFrame:
    """The registry (path, expected_sha256) with exists, sha256 and state; files: path and content."""
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"))
    out = registry.join(hashed, "path", "left").withColumn("exists", F.col("sha256").isNotNull())
    return out.withColumn("state", F.when(~F.col("exists"), "MISSING").when(F.col("expected_sha256").isNull(), "UNPINNED").when(F.col("sha256") == F.col("expected_sha256"), "MATCH").otherwise("MISMATCH"))


# K07
def updated_header(header: DataFrame, **given: object) -> DataFrame:
    """A header row with the given fields, each kept as it is where None is given."""
    return header.withColumns({k: F.coalesce(F.lit(v).cast(header.schema[k].dataType), F.col(k)) for k, v in given.items()})


# J10
def for_each_provider(labels: DataFrame, providers: Sequence[str]) -> DataFrame:
    """Every label once per provider of a fixed list, by exploding a literal."""
    return labels.withColumn("provider", F.explode(F.array(*[F.lit(p) for p in providers])))


# J15, R21
def auto_labels(template: DataFrame, report: DataFrame, keys: Sequence[str], status: Column) -> DataFrame:
    """The template's empty labels filled from a report, with where each came from."""
    both = template.join(report, list(keys), "left")
    blank = F.coalesce(F.trim("expected_status"), F.lit("")) == ""
    return both.withColumn("label_source", F.when(~blank, "hand").when(status.isNotNull(), "report").otherwise("none")).withColumn("expected_status", F.when(blank, status).otherwise(F.col("expected_status")))


# R28
def state_by_counts(done: Column, wanted: Column) -> Column:
    return F.when(F.coalesce(done, F.lit(0)) <= 0, "EMPTY").when(done >= wanted, "COMPLETE").otherwise("PARTIAL")


# A51
def preferred(a: str, b: str, measures: Sequence[tuple[str, float]]) -> Column:
    """struct(score_a, score_b, choice) of two summaries (struct columns): each measure's weight goes to the better one; a
    negative weight means that less is better; equal ones give it to none."""
    left, right = F.lit(0.0), F.lit(0.0)
    for name, weight in measures:
        x, y = (F.col(a)[name], F.col(b)[name]) if weight > 0 else (F.col(b)[name], F.col(a)[name])
        left = left + F.when(x > y, F.lit(abs(weight))).otherwise(0.0)
        right = right + F.when(y > x, F.lit(abs(weight))).otherwise(0.0)
    return F.struct(left.alias("score_a"), right.alias("score_b"), F.when(left > right, F.lit(a)).when(right > left, F.lit(b)).otherwise("tie").alias("choice"))
