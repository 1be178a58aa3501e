"""Queries of rule tables, and of event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import rules
from plumbline.plans.base import CANDIDATES, ITEMS, MANIFEST, ROUTES, candidates, items, manifest, rounded, routes
from plumbline.plans.registry import query
from plumbline.streaming.windows import session_lengths, windowed_counts
from plumbline.tables import table


@query("q_guard_reasons", f"SELECT candidate_id, array_to_string(list_filter([CASE WHEN score < 0.3 THEN 'SCORE_LOW' END, CASE WHEN confidence['full'] < 0.4 THEN 'CONFIDENCE_LOW' END, CASE WHEN summary.penalty > 0.3 THEN 'PENALTY_HIGH' END], lambda x: x IS NOT NULL), '|') AS reasons FROM {CANDIDATES}")
def guard_reasons(spark, d):
    """Names of the rules that hold, in order."""
    found = rules.reasons((F.col("score") < 0.3, "SCORE_LOW"), (F.try_element_at("confidence", F.lit("full")) < 0.4, "CONFIDENCE_LOW"), (F.col("summary.penalty") > 0.3, "PENALTY_HIGH"))
    return candidates(spark, d).select("candidate_id", F.array_join(found, "|").alias("reasons"))


_LIMITS = [("overall", "min", 0.62, "OVERALL_LOW"), ("face", "min", 0.6, "FACE_LOW"), ("skin", "max", 0.65, "SKIN_HIGH"), ("depth_3d", "min", None, "DEPTH_LOW")]


@query("q_gate", f"WITH m AS (SELECT run_id, unnest(['overall', 'face', 'skin', 'depth_3d']) AS metric, unnest([avg(scores.overall), avg(scores.face), avg(scores.skin), avg(scores.depth_3d)]) AS value FROM {ITEMS} GROUP BY run_id), l(metric, kind, bound, reason) AS (VALUES " + ", ".join(f"('{a}', '{b}', {'NULL' if c is None else c}::DOUBLE, '{e}')" for a, b, c, e in _LIMITS) + "), b AS (SELECT run_id, reason, (kind = 'min' AND value < bound) OR (kind = 'max' AND value > bound) AS broken FROM m JOIN l USING (metric)) SELECT run_id, coalesce(array_to_string(list(reason ORDER BY reason) FILTER (broken), '|'), '') AS failed, count(*) FILTER (broken) = 0 AS passed FROM b GROUP BY run_id")
def gate(spark, d):
    """Metrics of every run against a table of limits."""
    means = items(spark, d).groupBy("run_id").agg(*[F.avg(f"scores.{m}").alias(m) for m in ("overall", "face", "skin", "depth_3d")])
    long = means.select("run_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("overall", "face", "skin", "depth_3d")])).alias("x")).select("run_id", "x.*")
    limits = spark.createDataFrame(_LIMITS, "metric string, kind string, bound double, reason string")
    return rules.gate(long, limits, ["run_id"]).select("run_id", F.array_join("failed", "|").alias("failed"), "passed")


@query("q_view_votes", f"WITH v AS (SELECT route_id, coalesce((CASE WHEN face_bucket = 'frontal' THEN 0.5e0 ELSE 0 END), 0) + (CASE WHEN pose_frontal_strength >= 0.6 THEN 0.3e0 ELSE 0 END) AS f, (CASE WHEN face_bucket = 'three_quarter' THEN 0.5e0 ELSE 0 END) + (CASE WHEN body_yaw_deg BETWEEN 20 AND 65 THEN 0.2e0 ELSE 0 END) AS t, (CASE WHEN pose_profile_strength >= 0.5 THEN 0.4e0 ELSE 0 END) + (CASE WHEN body_yaw_deg BETWEEN 65 AND 115 THEN 0.4e0 ELSE 0 END) AS s FROM {ROUTES}) SELECT route_id, CASE WHEN f >= t AND f >= s THEN 'front' WHEN t >= s THEN 'three_quarter' ELSE 'side_90' END AS lane, greatest(f, t, s) AS score FROM v")
def view_votes(spark, d):
    """Additive evidence to a lane; the lane named first wins ties."""
    yaw = F.col("body_yaw_deg")
    votes = [("front", F.col("face_bucket") == "frontal", 0.5), ("front", F.col("pose_frontal_strength") >= 0.6, 0.3), ("three_quarter", F.col("face_bucket") == "three_quarter", 0.5), ("three_quarter", yaw.between(20, 65), 0.2), ("side_90", F.col("pose_profile_strength") >= 0.5, 0.4), ("side_90", yaw.between(65, 115), 0.4)]
    return routes(spark, d).select("route_id", rules.vote(["front", "three_quarter", "side_90"], votes).alias("v")).select("route_id", "v.lane", "v.score")


_SUPPRESS = [("front", "FACELINE_REFUSED"), ("*", "HANDS_REFUSED")]


@query("q_suppressed_reasons", f"SELECT lane, reason, count(*) AS n FROM (SELECT lane, unnest(reasons) AS reason FROM {CANDIDATES}) WHERE reason IS NOT NULL AND reason <> 'HANDS_REFUSED' AND NOT (lane = 'front' AND reason = 'FACELINE_REFUSED') GROUP BY ALL")
def suppressed_reasons(spark, d):
    """Reasons that a table suppresses, for one lane or for all."""
    table_ = spark.createDataFrame(_SUPPRESS, "lane string, reason string")
    return rules.suppressed(candidates(spark, d), "candidate_id", "lane", "reasons", table_).groupBy("lane", "reason").agg(F.count("*").alias("n"))


_TEXTS = [("HANDS_REFUSED", 1, "look at the hands"), ("FACELINE_REFUSED", 2, "look at the face"), ("FACELINE_STEADY", 3, "look at the face"), ("RELIEF_SHAKY", 4, "take it again")]


@query("q_recommendations", "WITH t(reason, place, text) AS (VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in _TEXTS) + f"), o AS (SELECT candidate_id, text, min(place) AS place FROM (SELECT DISTINCT candidate_id, unnest(reasons) AS reason FROM {CANDIDATES}) JOIN t USING (reason) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY place) AS rn FROM o) SELECT candidate_id, array_to_string(list(text ORDER BY place), '|') AS advice FROM r WHERE rn <= 2 GROUP BY candidate_id")
def recommendations(spark, d):
    """Texts of a row's reasons in the table's order."""
    texts = spark.createDataFrame(_TEXTS, "reason string, place int, text string")
    return rules.texts_for(candidates(spark, d), "candidate_id", "reasons", texts, 2).select("candidate_id", F.array_join("advice", "|").alias("advice"))


@query("q_requirements", f"WITH w(lane, status, least) AS (VALUES ('front', 'PASS', 100), ('back_180', 'PASS', 100000), ('top', 'PASS', 1)) SELECT lane, status, least, coalesce(found, 0) AS found FROM w LEFT JOIN (SELECT lane, status, count(*) AS found FROM {CANDIDATES} GROUP BY ALL) USING (lane, status) WHERE coalesce(found, 0) < least")
def requirements(spark, d):
    """Required pairs with too few rows."""
    wanted = spark.createDataFrame([("front", "PASS", 100), ("back_180", "PASS", 100000), ("top", "PASS", 1)], "lane string, status string, least int")
    return rules.unmet_requirements(candidates(spark, d), wanted, ["lane", "status"])


_WEIGHTS = [("front", "full", 0.7), ("front", "upper", 0.3), ("side_90", "full", 0.4), ("side_90", "depth_3d", 0.6)]


@query("q_lane_weights", "WITH w(lane, part, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in _WEIGHTS) + f"), s AS (SELECT candidate_id, lane, unnest(['full', 'upper', 'depth_3d']) AS part, unnest([scores['full'], scores['upper'], scores['depth_3d']]) AS v FROM {CANDIDATES}), m AS (SELECT candidate_id, round(sum(v * weight) / nullif(sum(weight) FILTER (v IS NOT NULL), 0), 6) AS proxy FROM s JOIN w USING (lane, part) GROUP BY candidate_id) SELECT c.candidate_id, proxy FROM {CANDIDATES} c LEFT JOIN m USING (candidate_id)")
def lane_weights(spark, d):
    """A mean whose weights depend on the lane."""
    parts = {p: F.try_element_at("scores", F.lit(p)) for p in ("full", "upper", "depth_3d")}
    return rounded(rules.weighted_by_lane(candidates(spark, d), "lane", parts, spark.createDataFrame(_WEIGHTS, "lane string, part string, weight double")).select("candidate_id", "proxy"))


@query("q_metric_pivot", f"SELECT route_id, lane_scores['front'] AS front, lane_scores['side_90'] AS side_90 FROM {ROUTES} WHERE len(map_keys(lane_scores)) > 0")
def metric_pivot(spark, d):
    """Metric rows as columns."""
    long = routes(spark, d).select("route_id", F.explode("lane_scores").alias("metric", "value"))
    return rules.pivot_metrics(long, ["route_id"], "metric", "value", ["front", "side_90"])


@query("q_card_updates", f"SELECT i.item_id, CASE WHEN c.run_id IS NOT NULL THEN c.status ELSE i.status END AS status, c.run_id IS NOT NULL AND i.status IS DISTINCT FROM c.status AS updated FROM {ITEMS} i LEFT JOIN {CANDIDATES} c ON i.run_id = c.run_id AND i.image = c.image")
def card_updates(spark, d):
    """Fields set from another table, with a mark on what changed."""
    return rules.compare_and_set(items(spark, d).select("run_id", "image", "item_id", "status"), candidates(spark, d), ["run_id", "image"], ["status"]).select("item_id", "status", "updated")


@query("q_least_coverage", f"WITH c AS (SELECT run_id, avg(CASE WHEN length(trim(seed)) > 0 THEN 1.0 ELSE 0 END) AS seed, avg(CASE WHEN length(trim(prompt_id)) > 0 THEN 1.0 ELSE 0 END) AS prompt_id FROM {MANIFEST} GROUP BY run_id) SELECT field, round(min(coverage), 6) AS coverage, count(*) AS manifests FROM (UNPIVOT c ON seed, prompt_id INTO NAME field VALUE coverage) GROUP BY field")
def least_coverage(spark, d):
    """The least coverage of each field over the runs."""
    per = manifest(spark, d).groupBy("run_id").agg(*[F.avg(F.when(F.length(F.trim(f)) > 0, 1.0).otherwise(0.0)).alias(f) for f in ("seed", "prompt_id")])
    long = per.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("coverage")) for f in ("seed", "prompt_id")])).alias("x")).select("x.*")
    return rounded(rules.least_coverage(long, "field", "coverage"))


@query("q_cache_precedence", "SELECT run_id, cache_state FROM (SELECT run_id, cache_state, row_number() OVER (PARTITION BY run_id ORDER BY CASE cache_state WHEN 'refreshed' THEN 1 WHEN 'hit' THEN 2 ELSE 3 END, cache_state) AS rn FROM parser_metrics WHERE cache_state IS NOT NULL) WHERE rn = 1")
def cache_precedence(spark, d):
    """The state of the first in order."""
    return rules.by_precedence(table(spark, d, "parser_metrics"), ["run_id"], "cache_state", ["refreshed", "hit"])


@query("q_schema_match", "SELECT run_id, CASE WHEN active_profile IS NULL AND finished_at IS NULL THEN 'UNAVAILABLE' WHEN active_profile IS NULL OR finished_at IS NULL THEN 'ONE_SIDED' WHEN active_profile = strftime(finished_at, '%Y') THEN 'MATCH' ELSE 'MISMATCH' END AS state FROM review_runs")
def schema_match(spark, d):
    """M21."""
    return table(spark, d, "review_runs").select("run_id", rules.schema_match("active_profile", F.date_format("finished_at", "yyyy")).alias("state"))


@query("q_best_detection", f"SELECT run_id, image, metric_id, provider_name FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY 0.6 * visible_body_ratio + 0.4 * garment_coverage_ratio DESC, metric_id) AS rn FROM parser_metrics WHERE visible_body_ratio IS NOT NULL AND garment_coverage_ratio IS NOT NULL) WHERE rn = 1")
def best_detection(spark, d):
    """The detection of the greatest composite, by a bounded aggregate."""
    rows = table(spark, d, "parser_metrics").filter("visible_body_ratio IS NOT NULL AND garment_coverage_ratio IS NOT NULL")
    score = 0.6 * F.col("visible_body_ratio") + 0.4 * F.col("garment_coverage_ratio")
    return rules.best_detection(rows, ["run_id"], score, ["image", "metric_id", "provider_name"], "metric_id")


@query("q_part_shares", "SELECT l_returnflag, l_linenumber, round(q / sum(q) OVER (PARTITION BY l_returnflag), 6) AS share FROM (SELECT l_returnflag, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linenumber)")
def part_shares(spark, d):
    """Shares of the parts of a whole."""
    return rounded(rules.part_shares(table(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber", "l_quantity"))


@query("q_integrity", f"SELECT item_id, issue FROM (SELECT item_id, unnest(list_filter([CASE WHEN NOT coalesce(scores.overall BETWEEN 0 AND 1, false) THEN 'OVERALL_OUT_OF_RANGE' END, CASE WHEN NOT coalesce(status IN ('PASS', 'WARN', 'FAIL'), false) THEN 'STATUS_UNKNOWN' END, CASE WHEN NOT coalesce(len(reasons) > 0, false) THEN 'REASONS_EMPTY' END], lambda x: x IS NOT NULL)) AS issue FROM {ITEMS})")
def integrity(spark, d):
    """The checks that a record fails."""
    return rules.record_issues(items(spark, d), "item_id", (F.col("scores.overall").between(0, 1), "OVERALL_OUT_OF_RANGE"), (F.col("status").isin("PASS", "WARN", "FAIL"), "STATUS_UNKNOWN"), (F.size("reasons") > 0, "REASONS_EMPTY"))


# -- events -----------------------------------------------------------------------------------------------------------


@query("q_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """§2.11, an extension: the windowed counts that the stream keeps, over the whole table."""
    return rounded(windowed_counts(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value").select("start", "event_type", "n", "total"), 4)


@query("q_event_sessions", "WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT user_id, ts, sum((before IS NULL OR epoch_us(ts) - epoch_us(before) >= 1800000000)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session")
def event_sessions(spark, d):
    """§2.11, an extension: sessions that end after half an hour of silence."""
    return session_lengths(table(spark, d, "events"), "ts", "30 minutes", ["user_id"]).select("user_id", "start", "n")
