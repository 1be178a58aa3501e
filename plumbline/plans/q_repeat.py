"""Queries of repeated measurements, replays and cohesion."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import vectors as vec
from plumbline.functions.scalars import finite_or_null
from plumbline.operators import cohesion, repeatability as rp, replay
from plumbline.plans.base import DECISIONS, ITEMS, decisions, items, rounded
from plumbline.plans.registry import query
from plumbline.tables import table

_D = "count({v}) AS {p}n, min({v}) AS {p}min, median({v}) AS {p}median, max({v}) AS {p}max, max({v}) - min({v}) AS {p}spread"


def _r(*names: str) -> str:
    return ", ".join(f'round("{n}", 6) AS "{n}"' for n in names)


@query("q_trial_summary", f"SELECT user_id, family, level, trials, n, {_r('min', 'median', 'max', 'spread')} FROM (SELECT user_id, event_type AS family, CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE 'family' END AS level, count(*) AS trials, {_D.format(v='value', p='')} FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id)))")
def trial_summary(spark, d):
    """Descriptors per source, and per source and family, by grouping sets."""
    return rounded(rp.trial_summary(table(spark, d, "events"), ["user_id"], "event_type", "value"))


@query("q_cohort", "WITH s AS (SELECT user_id, event_type, " + _D.format(v="value", p="s_") + " FROM events GROUP BY ALL), c AS (SELECT event_type, count(*) AS sources, sum(s_n)::BIGINT AS \"values\", " + ", ".join(_D.format(v=f"s_{m}", p=f"{m}_") for m in ("median", "max", "spread")) + " FROM s GROUP BY event_type) SELECT event_type, sources, \"values\", " + ", ".join(f"{m}_n, " + _r(*[f"{m}_{x}" for x in ("min", "median", "max", "spread")]) for m in ("median", "max", "spread")) + " FROM c")
def cohort(spark, d):
    """An aggregate of the sources' aggregates."""
    return rounded(rp.cohort_summary(table(spark, d, "events"), "user_id", "event_type", "value"))


_CQ = ", ".join(f"quantile_cont(v, {p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95))


@query("q_component_quantiles", f"WITH x AS (SELECT name, unnest(['signed', 'absolute']) AS kind, unnest([v, abs(v)]) AS v FROM (SELECT l_returnflag AS name, l_discount - l_tax AS v FROM lineitem)) SELECT name, kind, n, {_r('p5', 'p25', 'p50', 'p75', 'p95')} FROM (SELECT name, kind, count(v) AS n, {_CQ} FROM x GROUP BY ALL)")
def component_quantiles(spark, d):
    """Signed and absolute percentiles of each component."""
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") - F.col("l_tax")).alias("v"))
    return rounded(rp.component_quantiles(rows, [], "l_returnflag", "v"))


@query("q_chain_transitions", "WITH b AS (SELECT user_id, arg_min(event_type, event_id) AS base FROM events GROUP BY 1) SELECT user_id, count(*) AS assessed, count(*) FILTER (event_type <> base) AS transitions FROM events JOIN b USING (user_id) GROUP BY user_id")
def chain_transitions(spark, d):
    """How often a trial's signature differs from the source's first."""
    events = table(spark, d, "events")
    base = events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("base"))
    return rp.chain_transitions(events.join(base, "user_id"), ["user_id"], "base", "event_type")


@query("q_diagnostics", f"WITH e AS (SELECT lane, unnest(map_entries(lane_scores)) AS e FROM view_routes), r AS (SELECT coalesce(lane, '(null)') AS lane, e.key AS name, e.value AS v FROM e) SELECT lane, name, n, {_r('min', 'median', 'max', 'spread')} FROM (SELECT lane, name, {_D.format(v='v', p='')} FROM r GROUP BY ALL)")
def diagnostics(spark, d):
    """Descriptors of the entries of a map."""
    rows = table(spark, d, "view_routes").select(F.coalesce("lane", F.lit("(null)")).alias("lane"), "lane_scores")
    return rounded(rp.diagnostics_summary(rows, ["lane"], "lane_scores"))


@query("q_availability", "SELECT lane_side, count(*) AS trials, count(*) FILTER (isfinite(candidate_score)) AS available, round(count(*) FILTER (isfinite(candidate_score)) / count(*), 6) AS share FROM anchor_candidates GROUP BY lane_side")
def availability(spark, d):
    """Finite measurements by domain."""
    return rounded(rp.availability(table(spark, d, "anchor_candidates"), ["lane_side"], "candidate_score"))


#: domain, repetitions, transform, family, strength, unit: 3 + 4 + 6 trials (fixed values).
_PROTOCOL = [
    ("numerical_repeatability", 3, "identity", "none", 0.0, "none"),
    *[("codec_repeatability", 1, f"jpeg_{q}", "jpeg_roundtrip", float(q), "quality") for q in (95, 90, 85, 80)],
    *[("geometry_repeatability", 1, f"crop_{s}", "crop_translation", float(s), "percent") for s in (-3, -2, -1, 1, 2, 3)],
]


@query("q_trial_plan", "WITH p(domain, n, transform_id, family, signed_strength, unit) AS (VALUES " + ", ".join(f"('{a}', {b}, '{c}', '{e}', {f}::DOUBLE, '{g}')" for a, b, c, e, f, g in _PROTOCOL) + ") SELECT domain, CASE WHEN n > 1 THEN transform_id || '__repeat_' || lpad(i::VARCHAR, 2, '0') ELSE transform_id END AS trial_id, family, signed_strength, unit, i::INTEGER AS repeat_index FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM p)")
def trial_plan(spark, d):
    """13 trials out of a protocol."""
    return rp.trial_plan(spark.createDataFrame(_PROTOCOL, rp.PLAN)).select("domain", "trial_id", "family", "signed_strength", "unit", "repeat_index")


# -- replay -----------------------------------------------------------------------------------------------------------

_TRIALS = replay.prune_trials(replay.grid_trials(pass_at=[0.6, 0.65, 0.7, 0.75], warn_at=[0.45, 0.55, 0.65]), [("warn_at", "pass_at", 0.05)])
_TRIALS_SQL = "(VALUES " + ", ".join(f"({i}, {t['pass_at']}::DOUBLE, {t['warn_at']}::DOUBLE)" for i, t in enumerate(_TRIALS)) + ")"
_DECIDED = f"SELECT trial, pass_at, warn_at, status AS expected, CASE WHEN s >= pass_at THEN 'PASS' WHEN s >= warn_at THEN 'WARN' ELSE 'FAIL' END AS predicted, 1.0::DOUBLE AS weight FROM (SELECT status, scores.overall AS s FROM {ITEMS} WHERE status IN ('PASS', 'WARN', 'FAIL')), {_TRIALS_SQL} t(trial, pass_at, warn_at)"
_REPLAYED = (
    f"WITH x AS ({_DECIDED}), c AS (SELECT trial, pass_at, warn_at, expected, predicted, sum(weight) AS w FROM x GROUP BY ALL), k AS (SELECT trial, expected AS class FROM c UNION SELECT trial, predicted FROM c), s AS (SELECT trial, class, coalesce(sum(w) FILTER (expected = class AND predicted = class), 0) AS tp, coalesce(sum(w) FILTER (predicted = class), 0) AS pw, coalesce(sum(w) FILTER (expected = class), 0) AS ew FROM k JOIN c USING (trial) GROUP BY ALL), p AS (SELECT *, CASE WHEN pw > 0 THEN tp / pw ELSE 1 END AS pr, CASE WHEN ew > 0 THEN tp / ew ELSE 0 END AS re FROM s), m AS (SELECT trial, avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) AS macro_f1, coalesce(max(pr) FILTER (class = 'PASS'), 1) AS safe_precision FROM p GROUP BY trial), t AS (SELECT trial, pass_at, warn_at, sum(w) AS weight_sum, coalesce(sum(w) FILTER (expected = predicted), 0) / sum(w) AS accuracy, coalesce(sum(w) FILTER (predicted = 'PASS' AND expected <> 'PASS'), 0) / sum(w) AS false_rate FROM c GROUP BY ALL) "
    "SELECT trial, pass_at, warn_at, weight_sum, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(safe_precision, 6) AS safe_precision, round(false_rate, 6) AS false_rate, round(0.45 * macro_f1 + 0.35 * safe_precision + 0.2 * (1 - false_rate), 6) AS safety FROM t JOIN m USING (trial)"
)


def _replayed(spark, d):
    rows = items(spark, d).filter(F.col("status").isin("PASS", "WARN", "FAIL")).select("status", F.col("scores.overall").alias("s"), F.lit(1.0).alias("w"))
    predicted = F.when(F.col("s") >= F.col("trial.pass_at"), "PASS").when(F.col("s") >= F.col("trial.warn_at"), "WARN").otherwise("FAIL")
    return replay.replay(rows, _TRIALS, predicted, "status", "w")


@query("q_replay_whatif", _REPLAYED)
def replay_whatif(spark, d):
    """Every item decided again under each pair of thresholds, in one pass."""
    return rounded(_replayed(spark, d))


_MODULES = {"face": 0.4, "upper_body": 0.35, "full_body": 0.25}
_STATE_SQL = "CASE WHEN conf < 0.05 THEN 'FAIL' WHEN conf < 0.35 THEN 'WARN' WHEN {m} >= pass_at THEN 'PASS' WHEN {m} >= warn_at THEN 'WARN' ELSE 'FAIL' END"
_FINITE_SQL = "CASE WHEN isfinite(scores.{m}) THEN scores.{m} END"
_CHAINED = (
    "SELECT trial, pass_at, warn_at, expected, CASE WHEN failed AND fused < warn_at THEN 'FAIL' WHEN NOT failed AND fused >= pass_at THEN 'PASS' ELSE 'WARN' END AS predicted, 1.0::DOUBLE AS weight FROM (SELECT *, 'FAIL' IN ("
    + ", ".join(_STATE_SQL.format(m=m) for m in _MODULES)
    + ") AS failed, ("
    + " + ".join(f"coalesce({m}, 0) * ({w}::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * conf))" for m, w in _MODULES.items())
    + ") / ("
    + " + ".join(f"{w}::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * conf)" for w in _MODULES.values())
    + ") AS fused FROM (SELECT status AS expected, coalesce("
    + _FINITE_SQL.format(m="constitution")
    + ", 0) AS conf, "
    + ", ".join(f"{_FINITE_SQL.format(m=m)} AS {m}" for m in _MODULES)
    + f" FROM {ITEMS} WHERE status IN ('PASS', 'WARN', 'FAIL')), {_TRIALS_SQL} t(trial, pass_at, warn_at))"
)


@query("q_replay_chain", _REPLAYED.replace(_DECIDED, _CHAINED))
def replay_chain(spark, d):
    """Modules classified, scores fused and the item decided under each trial's thresholds, in one pass."""
    scores = {m: finite_or_null(F.col(f"scores.{m}")) for m in _MODULES}
    conf = F.coalesce(finite_or_null(F.col("scores.constitution")), F.lit(0.0))
    rows = items(spark, d).filter(F.col("status").isin("PASS", "WARN", "FAIL")).select("status", conf.alias("conf"), *[c.alias(m) for m, c in scores.items()], F.lit(1.0).alias("w"))
    states = F.array(*[replay.classify_module(m, "conf", "trial.pass_at", "trial.warn_at", m)["state"] for m in _MODULES])
    fused = replay.fused_score([(m, "conf", w) for m, w in _MODULES.items()])
    failed = F.array_contains(states, "FAIL")
    predicted = F.when(failed & (fused < F.col("trial.warn_at")), "FAIL").when(~failed & (fused >= F.col("trial.pass_at")), "PASS").otherwise("WARN")
    return rounded(replay.replay(rows, _TRIALS, predicted, "status", "w"))


@query("q_best_trials", f"SELECT trial, safety FROM ({_REPLAYED}) ORDER BY safety DESC, trial LIMIT 3")
def best_trials(spark, d):
    """The three best trials."""
    return replay.best_trials(rounded(_replayed(spark, d)), 3).select("trial", "safety")


@query("q_constraint_prune", f"SELECT trial, pass_at, warn_at FROM {_TRIALS_SQL} t(trial, pass_at, warn_at) WHERE warn_at + 0.05 <= pass_at + 1e-12")
def constraint_prune(spark, d):
    """The trials that keep the order of their thresholds."""
    return spark.createDataFrame([(i, t["pass_at"], t["warn_at"]) for i, t in enumerate(_TRIALS)], "trial int, pass_at double, warn_at double")


@query("q_classify_module", f"SELECT item_id, CASE WHEN c < 0.05 THEN 'FAIL' WHEN c < 0.35 THEN 'WARN' WHEN s >= 0.7 THEN 'PASS' WHEN s >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS state, CASE WHEN c < 0.05 THEN 'FACE_NO_RELIABLE_SIGNAL' WHEN c < 0.35 AND s >= 0.5 THEN 'FACE_LOW_CONFIDENCE|FACE_LOW_CONF_BUT_ACCEPTABLE' WHEN c < 0.35 THEN 'FACE_LOW_CONFIDENCE|FACE_LOW_CONF_NEEDS_REVIEW' WHEN s >= 0.7 THEN 'FACE_PASS' WHEN s >= 0.5 THEN 'FACE_WARN' ELSE 'FACE_FAIL' END AS reasons FROM (SELECT item_id, scores.face AS s, coalesce(scores.skin, 0) AS c FROM {ITEMS})")
def classify_module(spark, d):
    """State and reasons from score and confidence."""
    rows = items(spark, d).select("item_id", F.col("scores.face").alias("s"), F.coalesce("scores.skin", F.lit(0.0)).alias("c"), F.lit(0.7).alias("p"), F.lit(0.5).alias("w"))
    return rows.select("item_id", replay.classify_module("s", "c", "p", "w", "face").alias("m")).select("item_id", "m.state", F.array_join("m.reasons", "|").alias("reasons"))


@query("q_fused_score", f"SELECT item_id, (f * wf + u * wu) / (wf + wu) AS score FROM (SELECT item_id, scores.face AS f, scores.upper_body AS u, 0.5e0 * (0.25e0 + 0.75e0 * coalesce(scores.skin, 0)) AS wf, 0.3e0 * (0.25e0 + 0.75e0 * coalesce(scores.depth_3d, 0)) AS wu FROM {ITEMS}) WHERE f IS NOT NULL AND u IS NOT NULL")
def fused_score(spark, d):
    """Fusion weighted by confidence."""
    rows = items(spark, d).filter("scores.face IS NOT NULL AND scores.upper_body IS NOT NULL")
    return rows.select("item_id", replay.fused_score([("scores.face", "scores.skin", 0.5), ("scores.upper_body", "scores.depth_3d", 0.3)]).alias("score"))


# -- cohesion ---------------------------------------------------------------------------------------------------------

_UNITS = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
_CENTRES = _UNITS + ", l AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM u), s AS (SELECT label, p, sum(x) AS x FROM l GROUP BY ALL), c AS (SELECT label, list(x ORDER BY p) AS s FROM s GROUP BY label), n AS (SELECT label, list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) AS centroid FROM c)"


@query("q_centroid", f"WITH {_CENTRES} SELECT label, p::INTEGER AS p, round(x, 6) AS x FROM (SELECT label, unnest(centroid) AS x, generate_subscripts(centroid, 1) - 1 AS p FROM n)")
def centroid(spark, d):
    """The unit centroid of each label."""
    centres = cohesion.centroids(table(spark, d, "embeddings"), "label", "embedding", dims=64)
    return rounded(centres.select("label", F.posexplode("centroid").alias("p", "x")))


@query("q_centroid_similarity", f"WITH {_CENTRES} SELECT vec_id, label, round(list_dot_product(v, centroid), 6) AS similarity FROM u JOIN n USING (label)")
def centroid_similarity(spark, d):
    """F11, A46."""
    return rounded(cohesion.similarity_to_centroid(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 64).select("vec_id", "label", "similarity"))


@query("q_centroid_outliers", f"WITH {_CENTRES}, m AS (SELECT vec_id, label, list_dot_product(v, centroid) AS s FROM u JOIN n USING (label)), k AS (SELECT label, median(s) AS centre FROM m GROUP BY 1), a AS (SELECT label, centre, greatest(0.01, 1.4826 * median(abs(s - centre))) AS scale FROM m JOIN k USING (label) GROUP BY ALL) SELECT vec_id, round(greatest(0, (centre - s) / scale), 4) AS z FROM m JOIN a USING (label) WHERE greatest(0, (centre - s) / scale) >= 2")
def centroid_outliers(spark, d):
    """Rows far from their centroid on the low side."""
    near = cohesion.similarity_to_centroid(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 64)
    return rounded(cohesion.centroid_outliers(near, "label", 2.0, -1.0).filter("outlier").select("vec_id", "z"), 4)


@query("q_pairwise_median", f"WITH {_UNITS} SELECT label, count(*) AS pairs, round(median(list_dot_product(a.v, b.v)), 3) AS median FROM u a JOIN u b USING (label) WHERE a.vec_id < b.vec_id GROUP BY label")
def pairwise_median(spark, d):
    """The median similarity within each label, by blocks of bounded size."""
    return rounded(cohesion.pairwise_medians(table(spark, d, "embeddings"), "label", "vec_id", "embedding"), 3)


@query("q_drift_flags", f"WITH {_CENTRES}, m AS (SELECT list_dot_product(v, centroid) AS s FROM u JOIN n USING (label)) SELECT CASE WHEN s >= 0.9 THEN 'STEADY' WHEN s >= 0.75 THEN 'WATCH' ELSE 'DRIFT' END AS flag, count(*) AS n FROM m GROUP BY 1")
def drift_flags(spark, d):
    """Flags by the distance to a bank of centroids, counted."""
    rows = table(spark, d, "embeddings")
    bank = cohesion.centroids(rows, "label", "embedding", dims=64)
    return cohesion.drift(rows, "vec_id", "embedding", bank, "label").groupBy("flag").agg(F.count("*").alias("n"))


@query("q_angular_distance", f"WITH {_UNITS}, z AS (SELECT v FROM u WHERE vec_id = 0) SELECT u.vec_id, round(acos(greatest(-1, least(1, list_dot_product(u.v, z.v)))), 5) AS radians FROM u, z WHERE u.vec_id > 0")
def angular_distance(spark, d):
    """angles to one reference vector."""
    rows = table(spark, d, "embeddings")
    held = rows.filter("vec_id = 0").select("embedding").first().embedding  # one row
    reference = F.array(*[F.lit(float(x)) for x in held])
    return rounded(rows.filter("vec_id > 0").select("vec_id", vec.angular_distance("embedding", reference).alias("a")).select("vec_id", "a.radians"), 5)


@query("q_selection_penalty", f"WITH w(reason, p) AS (VALUES ('FACELINE_REFUSED', 0.2), ('HANDS_REFUSED', 0.15), ('RELIEF_SHAKY', 0.1), ('CROPBOX_BLURRY_EDGE', 0.05)), e AS (SELECT DISTINCT candidate_id, unnest(reasons) AS reason FROM anchor_candidates) SELECT candidate_id, round(least(0.45, coalesce(sum(p), 0))::DOUBLE, 6) AS penalty FROM anchor_candidates LEFT JOIN (SELECT candidate_id, p FROM e JOIN w USING (reason)) USING (candidate_id) GROUP BY candidate_id")
def selection_penalty(spark, d):
    """Looked up in a fixed table within the row, capped."""
    weights = {"FACELINE_REFUSED": 0.2, "HANDS_REFUSED": 0.15, "RELIEF_SHAKY": 0.1, "CROPBOX_BLURRY_EDGE": 0.05}
    rows = table(spark, d, "anchor_candidates").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    return rounded(rows.select("candidate_id", replay.penalty("reasons", weights).alias("penalty")))


@query("q_lane_agreement", f"SELECT expected, round(sum(CASE WHEN predicted = expected THEN weight ELSE 0 END), 6) AS agreed, round(sum(weight), 6) AS total FROM {DECISIONS} GROUP BY expected")
def lane_agreement(spark, d):
    """Partial sums that Catalyst combines before the shuffle."""
    return rounded(decisions(spark, d).groupBy("expected").agg(F.sum(F.when(F.col("predicted") == F.col("expected"), F.col("weight")).otherwise(0.0)).alias("agreed"), F.sum("weight").alias("total")))


@query("q_every_domain", "WITH s AS (SELECT trim(lane_side) AS domain, count(*) AS trials FROM anchor_candidates GROUP BY trim(lane_side)) SELECT d.domain, s.trials, CASE WHEN coalesce(s.trials, 0) > 0 THEN 'OBSERVED' ELSE 'NOT_MEASURED' END AS state FROM (VALUES ('left'), ('right'), ('none'), ('above')) d(domain) LEFT JOIN s USING (domain)")
def every_domain(spark, d):
    """Every domain of a protocol, those without trials too."""
    summary = table(spark, d, "anchor_candidates").groupBy(F.trim("lane_side").alias("domain")).agg(F.count("*").alias("trials"))
    return rp.with_every_domain(summary, ["left", "right", "none", "above"], spark)
