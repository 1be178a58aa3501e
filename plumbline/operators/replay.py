"""

A trial is a row of a threshold table. Its replay is one pass: the trials, a bounded list made on the driver, travel as
one array literal, every row is decided under each of them by column expressions, and only partial confusion counts are
shuffled.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import ColumnLike, col, finite_or_null, number_or
from plumbline.operators.aggregates import overall_metrics

MOST_TRIALS = 10_000


# R01
def classify_module(score: ColumnLike, confidence: ColumnLike, pass_at: ColumnLike, warn_at: ColumnLike, module: str, no_signal: float = 0.05, low_confidence: float = 0.35) -> Column:
    """struct(state, reasons) of one module: without signal FAIL, with little confidence WARN, else by the score."""
    s, c, name = finite_or_null(col(score)), F.coalesce(finite_or_null(col(confidence)), F.lit(0.0)), module.upper()
    reason = lambda *r: F.array(*[F.lit(f"{name}_{x}") for x in r])
    pair = lambda state, reasons: F.struct(F.lit(state).alias("state"), reasons.alias("reasons"))
    return (
        F.when(c < no_signal, pair("FAIL", reason("NO_RELIABLE_SIGNAL")))
        .when((c < low_confidence) & (s >= col(warn_at)), pair("WARN", reason("LOW_CONFIDENCE", "LOW_CONF_BUT_ACCEPTABLE")))
        .when(c < low_confidence, pair("WARN", reason("LOW_CONFIDENCE", "LOW_CONF_NEEDS_REVIEW")))
        .when(s >= col(pass_at), pair("PASS", reason("PASS")))
        .when(s >= col(warn_at), pair("WARN", reason("WARN")))
        .otherwise(pair("FAIL", reason("FAIL")))
    )


# R02
def fused_score(parts: Sequence[tuple[ColumnLike, ColumnLike, float]], floor: float = 0.25, scale: float = 0.75) -> Column:
    """Mean of (score, confidence, weight), each weight times floor + scale * confidence; 0 without weight."""
    above, below = F.lit(0.0), F.lit(0.0)
    for score, confidence, weight in parts:
        w = weight * (floor + scale * F.coalesce(col(confidence), F.lit(0.0)))
        above, below = above + F.coalesce(col(score), F.lit(0.0)) * w, below + w
    return F.when(below >= 1e-8, above / F.nullif(below, F.lit(0.0))).otherwise(0.0)


# R10
def penalty(reasons: ColumnLike, weights: dict[str, float], most: float = 0.45) -> Column:
    """Sum of the weights of the distinct reasons, at most most. weights is a fixed table of the caller."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    one = lambda a, r: a + F.coalesce(F.try_element_at(table, r), F.lit(0.0))
    return F.least(F.lit(most), F.aggregate(F.array_distinct(F.filter(col(reasons), lambda r: r.isNotNull())), F.lit(0.0), one))


# X10
def grid_trials(**values: Sequence[float]) -> list[dict[str, float]]:
    """Every combination of the given values."""
    return [dict(zip(values, combination)) for combination in itertools.product(*values.values())]


def random_trials(space: dict[str, tuple[float, float]], n: int, seed: int = 42) -> list[dict[str, float]]:
    rng = random.Random(seed)
    return [{k: round(rng.uniform(low, high), 6) for k, (low, high) in space.items()} for _ in range(n)]


def prune_trials(trials: list[dict[str, float]], order: Sequence[tuple[str, str, float]]) -> list[dict[str, float]]:
    """The trials that keep every (lower, upper, gap): lower + gap <= upper."""
    return [t for t in trials if all(t[low] + gap <= t[high] + 1e-12 for low, high, gap in order)]


def replay(rows: DataFrame, trials: list[dict[str, float]], predicted: Column, expected: str, weight: str, safe: str = "PASS") -> DataFrame:
    """trial, its values, and the overall metrics of the decisions under it.

    predicted refers to the trial's values as trial.<name>.
    """
    if len(trials) > MOST_TRIALS:
        raise ValueError(f"more than {MOST_TRIALS} trials")
    names = sorted(trials[0])
    literal = F.array(*[F.struct(F.lit(i).alias("number"), *[F.lit(float(t[n])).alias(n) for n in names]) for i, t in enumerate(trials)])
    asked = rows.withColumn("trial", F.explode(literal))
    values = [F.col(f"trial.{n}").alias(n) for n in names]
    cells = asked.select(F.col("trial.number").alias("trial"), *values, F.col(expected).alias("expected"), predicted.alias("predicted"), F.col(weight).alias("weight"))
    cells = cells.groupBy("trial", *names, "expected", "predicted").agg(F.sum("weight").alias("weight"))
    return overall_metrics(cells, safe, ["trial", *names])


def best_trials(metrics: DataFrame, n: int = 10, by: str = "safety") -> DataFrame:
    """The n best trials, ties by their number."""
    return metrics.orderBy(F.col(by).desc(), "trial").limit(n)


# X09
def apply_overrides(settings: dict[str, float | bool | int], overrides: dict[str, object]) -> dict:
    """Settings with overrides by dotted path, each of the type of what it replaces; an unknown path is an error."""
    out = dict(settings)
    for path, value in overrides.items():
        if path not in out:
            raise KeyError(f"unknown setting {path}")
        kind = type(out[path])
        if kind is bool and not isinstance(value, bool) or kind in (int, float) and (isinstance(value, bool) or not isinstance(value, (int, float))):
            raise TypeError(f"{path} must be {kind.__name__}")
        out[path] = kind(value)
    return out


# P17
def get_path(tree: dict, path: str, default: object = None) -> object:
    for part in path.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return default
        tree = tree[part]
    return tree


def set_path(tree: dict, path: str, value: object) -> dict:
    """A new tree with the value at the path."""
    head, _, rest = path.partition(".")
    below = tree.get(head)
    return {**tree, head: set_path(below if isinstance(below, dict) else {}, rest, value) if rest else value}


def merge_trees(base: dict, over: dict) -> dict:
    """over onto base, dictionaries merged, other values replaced."""
    return {**base, **{k: merge_trees(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


# M02
def space_issues(parameters: Sequence[dict]) -> list[str]:
    """What is wrong with the rows of a search space; empty for a good one."""
    issues = []
    seen: set[str] = set()
    for row in parameters:
        name, kind = str(row.get("name") or ""), row.get("type")
        if not name or name in seen:
            issues.append(f"NAME_MISSING_OR_REPEATED:{name}")
        seen.add(name)
        if kind not in ("float", "int", "categorical"):
            issues.append(f"TYPE_UNKNOWN:{name}")
        elif kind == "categorical":
            if not row.get("choices"):
                issues.append(f"CHOICES_MISSING:{name}")
        elif number(row.get("low")) is None or number(row.get("high")) is None or number(row["low"]) >= number(row["high"]):
            issues.append(f"BOUNDS_INVALID:{name}")
        elif row.get("log") and (row.get("step") is not None or number(row["low"]) <= 0):
            issues.append(f"LOG_INVALID:{name}")
    return issues


def number(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


__all__ = ["apply_overrides", "best_trials", "classify_module", "fused_score", "get_path", "grid_trials", "merge_trees", "number_or", "penalty", "prune_trials", "random_trials", "replay", "set_path", "space_issues"]
