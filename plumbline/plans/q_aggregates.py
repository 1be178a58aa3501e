"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalars as sc
from plumbline.operators import aggregates as ag
from plumbline.operators.running import distributed_rank, exact_percentiles
from plumbline.plans.base import CANDIDATES, DECISIONS, ITEMS, MANIFEST, ROUTES, candidates, decisions, items, manifest, rounded, routes, strip_sql
from plumbline.plans.registry import query
from plumbline.tables import strip, table

_CELLS = f"SELECT expected, coalesce(predicted, 'missing') AS predicted, sum(weight) AS weight, count(*) AS items FROM {DECISIONS} GROUP BY ALL"


def _cells(spark, d):
    return ag.confusion(decisions(spark, d).withColumn("predicted", F.coalesce("predicted", F.lit("missing"))), "expected", "predicted", "weight")


@query("q_confusion", _CELLS)
def confusion(spark, d):
    """Weighted confusion of intended and routed lanes."""
    return _cells(spark, d)


_CLASSES = f"WITH c AS ({_CELLS}), k AS (SELECT expected AS class FROM c UNION SELECT predicted FROM c), s AS (SELECT class, coalesce(sum(weight) FILTER (expected = class AND predicted = class), 0) AS tp, coalesce(sum(weight) FILTER (predicted = class), 0) AS predicted_weight, coalesce(sum(weight) FILTER (expected = class), 0) AS expected_weight FROM k, c GROUP BY class), p AS (SELECT *, CASE WHEN predicted_weight > 0 THEN tp / predicted_weight ELSE 1 END AS precision, CASE WHEN expected_weight > 0 THEN tp / expected_weight ELSE 0 END AS recall FROM s), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p)"


@query("q_class_metrics", _CLASSES + " SELECT class, tp, predicted_weight, expected_weight, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def class_metrics(spark, d):
    """Precision, recall and F1 per lane."""
    return rounded(ag.class_metrics(_cells(spark, d)))


@query(
    "q_overall_metrics",
    _CLASSES + ", t AS (SELECT sum(weight) AS weight_sum, coalesce(sum(weight) FILTER (expected = predicted), 0) AS hit, coalesce(sum(weight) FILTER (predicted = 'front' AND expected <> 'front'), 0) AS wrong FROM c), m AS (SELECT avg(f1) AS macro_f1, coalesce(max(precision) FILTER (class = 'front'), 1) AS safe_precision FROM f) "
    "SELECT weight_sum, round(hit / weight_sum, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(safe_precision, 6) AS safe_precision, round(wrong / weight_sum, 6) AS false_rate, round(0.45 * macro_f1 + 0.35 * safe_precision + 0.2 * (1 - wrong / weight_sum), 6) AS safety FROM t, m",
)
def overall(spark, d):
    """Macro F1, false rate and the safety composite."""
    return rounded(ag.overall_metrics(_cells(spark, d), "front"))


@query(
    "q_group_metrics",
    f"WITH x AS (SELECT expected, coalesce(route_source, '(none)') AS route_source, weight, predicted = expected AS hit FROM {DECISIONS}) SELECT expected, route_source, CASE WHEN grouping(expected) = 0 THEN 'expected' WHEN grouping(route_source) = 0 THEN 'route_source' ELSE 'all' END AS level, count(*) AS items, round(sum(CASE WHEN hit THEN weight ELSE 0 END) / nullif(sum(weight) FILTER (hit IS NOT NULL), 0), 6) AS accuracy FROM x GROUP BY GROUPING SETS ((expected), (route_source), ())",
)
def group_metrics(spark, d):
    """Accuracy by lane, by route source and of all, in one pass of grouping sets."""
    rows = decisions(spark, d).select("expected", F.coalesce("route_source", F.lit("(none)")).alias("route_source"), "weight", (F.col("predicted") == F.col("expected")).alias("hit"))
    return rounded(ag.grouped_accuracy(rows, [["expected"], ["route_source"], []], "hit", "weight"))


@query("q_status_counts", f"SELECT coalesce(nullif(status, ''), 'UNKNOWN') AS status, count(*) AS n FROM {ITEMS} GROUP BY 1")
def status_counts(spark, d):
    """A01."""
    return ag.count_by(items(spark, d).select(F.coalesce(F.nullif("status", F.lit("")), F.lit("UNKNOWN")).alias("status")), "status")


@query("q_module_unpivot", f"SELECT module, state, count(*) AS n FROM (SELECT unnest(['face', 'upper_body', 'full_body']) AS module, unnest([module_state.face, module_state.upper_body, module_state.full_body]) AS state FROM {ITEMS}) GROUP BY ALL")
def module_unpivot(spark, d):
    """Counts of the module states by one pass over the rows."""
    return ag.count_unpivoted(items(spark, d), ["module_state.face", "module_state.upper_body", "module_state.full_body"])


@query("q_optional_accuracy", f"SELECT anchor_source, round(sum(CASE WHEN predicted = expected THEN weight ELSE 0 END) / nullif(sum(weight) FILTER (predicted IS NOT NULL), 0), 6) AS accuracy, count(*) AS items FROM {DECISIONS} GROUP BY anchor_source")
def optional_accuracy(spark, d):
    """Null where no image was routed."""
    rows = decisions(spark, d).withColumn("hit", F.col("predicted") == F.col("expected"))
    return rounded(rows.groupBy("anchor_source").agg(ag.optional_accuracy("hit", "weight").alias("accuracy"), F.count("*").alias("items")))


@query("q_weighted_mean_null", f"SELECT task_profile, round(sum(scores.depth_3d * scores.overall) / nullif(sum(scores.overall) FILTER (scores.depth_3d IS NOT NULL), 0), 6) AS mean FROM {ITEMS} GROUP BY task_profile")
def weighted_mean_null(spark, d):
    """A11 down a column: nulls skipped, weights renormalised."""
    return rounded(items(spark, d).groupBy("task_profile").agg(ag.weighted_mean("scores.depth_3d", "scores.overall").alias("mean")))


_ROW_MEAN = "(CASE WHEN {a} IS NULL AND {b} IS NULL AND {c} IS NULL THEN NULL ELSE (coalesce({a} * 0.5e0, 0) + coalesce({b} * 0.3e0, 0) + coalesce({c} * 0.2e0, 0)) / ((CASE WHEN {a} IS NULL THEN 0e0 ELSE 0.5e0 END) + (CASE WHEN {b} IS NULL THEN 0e0 ELSE 0.3e0 END) + (CASE WHEN {c} IS NULL THEN 0e0 ELSE 0.2e0 END)) END)".format(a="scores.constitution", b="scores.skin", c="scores.depth_3d")


@query("q_row_weighted_mean", f"SELECT item_id, {_ROW_MEAN} AS mean FROM {ITEMS}")
def row_weighted_mean(spark, d):
    """A11, A12, A13 along a row."""
    return items(spark, d).select("item_id", sc.row_weighted_mean([("scores.constitution", 0.5), ("scores.skin", 0.3), ("scores.depth_3d", 0.2)]).alias("mean"))


@query("q_geo_mean", f"SELECT quota_bucket, round(exp(avg(ln(greatest(1e-4::DOUBLE, least(1.0::DOUBLE, scores.overall))))), 6) AS mean FROM {ITEMS} WHERE scores.overall IS NOT NULL GROUP BY quota_bucket")
def geometric_mean(spark, d):
    """A14."""
    return rounded(items(spark, d).filter("scores.overall IS NOT NULL").groupBy("quota_bucket").agg(ag.geometric_mean("scores.overall").alias("mean")))


@query("q_stability", f"SELECT run_id, count(scores.overall) AS n, round(CASE WHEN count(scores.overall) = 1 THEN 0.58 WHEN count(scores.overall) > 1 THEN greatest(0::DOUBLE, least(1::DOUBLE, 1 - stddev_pop(scores.overall) / 0.08)) END, 6) AS stability FROM {ITEMS} GROUP BY run_id")
def stability(spark, d):
    """By the population deviation, with a default for single rows."""
    return rounded(items(spark, d).groupBy("run_id").agg(F.count("scores.overall").alias("n"), ag.stability("scores.overall", 0.08).alias("stability")))


_MAD = "WITH v AS (SELECT event_id, event_type, value FROM events WHERE value IS NOT NULL), c AS (SELECT event_type, median(value) AS centre FROM v GROUP BY 1), m AS (SELECT v.event_type, centre, median(abs(value - centre)) AS mad FROM v JOIN c USING (event_type) GROUP BY 1, 2), s AS (SELECT *, greatest(0.02, 1.4826 * mad) AS scale FROM m)"


@query("q_mad_outliers", _MAD + " SELECT event_id, v.event_type, round(abs(value - centre) / scale, 6) AS z FROM v JOIN s USING (event_type) WHERE abs(value - centre) / scale >= 3.2")
def mad_outliers(spark, d):
    """Rows beyond a robust z of 3.2 within their type."""
    return rounded(ag.robust_outliers(table(spark, d, "events"), ["event_type"], "value").select("event_id", "event_type", "z"))


_LOOK = f"SELECT collection_meta.layer_key AS layer, collection_meta.look_key AS look, count(*) AS images, avg(scores.overall) AS quality, CASE WHEN count(scores.overall) = 1 THEN 0.58 WHEN count(scores.overall) > 1 THEN greatest(0::DOUBLE, least(1::DOUBLE, 1 - stddev_pop(scores.overall) / 0.08)) END AS continuity FROM {ITEMS} WHERE collection_meta.groupable AND coalesce(trim(collection_meta.layer_key), '') <> '' AND coalesce(trim(collection_meta.look_key), '') <> '' GROUP BY ALL"


@query("q_two_level_agg", f"WITH l AS ({_LOOK}) SELECT layer, count(*) AS looks, sum(images)::BIGINT AS images, round(avg(quality), 6) AS quality, round(avg(continuity), 6) AS continuity FROM l GROUP BY layer")
def two_level(spark, d):
    """Looks, then layers of looks; the second aggregation reads what the first one left."""
    rows = items(spark, d).filter(F.col("collection_meta.groupable") & (F.coalesce(F.trim("collection_meta.layer_key"), F.lit("")) != "") & (F.coalesce(F.trim("collection_meta.look_key"), F.lit("")) != ""))
    looks = rows.groupBy(F.col("collection_meta.layer_key").alias("layer"), F.col("collection_meta.look_key").alias("look")).agg(F.count("*").alias("images"), F.avg("scores.overall").alias("quality"), ag.stability("scores.overall", 0.08).alias("continuity"))
    return rounded(looks.groupBy("layer").agg(F.count("*").alias("looks"), F.sum("images").alias("images"), F.avg("quality").alias("quality"), F.avg("continuity").alias("continuity")))


@query("q_view_coverage", f"SELECT run_id, len(list_intersect(list(DISTINCT lane), ['front', 'side_90', 'back_180'])) / 3.0::DOUBLE AS coverage FROM {ROUTES} GROUP BY run_id")
def view_coverage(spark, d):
    """Share of three expected lanes that a run has."""
    return routes(spark, d).groupBy("run_id").agg(ag.set_coverage("lane", ["front", "side_90", "back_180"]).alias("coverage"))


@query("q_dominant_lane", f"SELECT run_id, dominant, round(n / total, 6) AS share FROM (SELECT run_id, lane AS dominant, count(*) AS n, sum(count(*)) OVER (PARTITION BY run_id) AS total, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, lane) AS rn FROM {ROUTES} GROUP BY run_id, lane) WHERE rn = 1")
def dominant_lane(spark, d):
    """Ties by name."""
    return rounded(ag.dominant(routes(spark, d), ["run_id"], "lane"))


@query("q_lane_entropy", f"WITH c AS (SELECT run_id, lane, count(*) AS n FROM {ROUTES} GROUP BY ALL), p AS (SELECT run_id, n / sum(n) OVER (PARTITION BY run_id) AS p FROM c), e AS (SELECT run_id, count(*) AS classes, -sum(p * log2(p)) AS bits FROM p GROUP BY run_id) SELECT run_id, classes, round(abs(bits), 6) AS entropy, round(CASE WHEN classes > 1 THEN 1 - bits / log2(classes) ELSE 1 END, 6) AS purity FROM e")
def lane_entropy(spark, d):
    """A34."""
    return rounded(ag.entropy(routes(spark, d), ["run_id"], "lane"))


@query("q_field_coverage", f"WITH t AS (SELECT count(*) AS n, count(*) FILTER (length(trim(prompt_id)) > 0) AS prompt_id, count(*) FILTER (length(trim(seed)) > 0) AS seed, count(*) FILTER (length(trim(seed_unavailable_reason)) > 0) AS seed_unavailable_reason, count(*) FILTER (length(trim(anchor_source)) > 0) AS anchor_source, count(*) FILTER (length(trim(intended_view)) > 0) AS intended_view FROM {MANIFEST}) SELECT field, present, n - present AS missing, round(present / greatest(n, 1), 6) AS coverage FROM (UNPIVOT t ON prompt_id, seed, seed_unavailable_reason, anchor_source, intended_view INTO NAME field VALUE present)")
def field_coverage(spark, d):
    """Five fields by one pass."""
    return rounded(ag.field_coverage(manifest(spark, d), ["prompt_id", "seed", "seed_unavailable_reason", "anchor_source", "intended_view"]))


@query("q_conditional_coverage", f"SELECT task_profile, round(avg(CASE WHEN scores.depth_3d IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS depth, round(avg(CASE WHEN scores.skin >= 0.5 THEN 1.0 ELSE 0 END), 6) AS skin, round(avg(CASE WHEN module_state.face = 'PASS' THEN 1.0 ELSE 0 END), 6) AS face FROM {ITEMS} GROUP BY task_profile")
def conditional_coverage(spark, d):
    """Shares of predicates; null is a miss."""
    face = F.col("module_state.face") == "PASS"
    return rounded(items(spark, d).groupBy("task_profile").agg(ag.coverage(F.col("scores.depth_3d").isNotNull()).alias("depth"), ag.coverage(F.col("scores.skin") >= 0.5).alias("skin"), ag.coverage(face).alias("face")))


_DESCRIPTOR = "count({v}) AS {p}n, min({v}) AS {p}min, median({v}) AS {p}median, max({v}) AS {p}max, max({v}) - min({v}) AS {p}spread"


@query("q_descriptor", "SELECT event_type, n, round(\"min\", 6) AS \"min\", round(\"median\", 6) AS \"median\", round(\"max\", 6) AS \"max\", round(spread, 6) AS spread FROM (SELECT event_type, " + _DESCRIPTOR.format(v="value", p="") + " FROM events WHERE isfinite(value) GROUP BY event_type)")
def descriptor(spark, d):
    """A24."""
    return rounded(ag.describe(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value"))


@query("q_percentile_calibration", f"SELECT lane, count(score) AS n, round(CASE WHEN count(score) >= 8 THEN quantile_cont(score, 0.10) END, 6) AS p10, round(CASE WHEN count(score) >= 8 THEN quantile_cont(score, 0.15) END, 6) AS p15 FROM {CANDIDATES} GROUP BY lane")
def percentile_calibration(spark, d):
    """Exact interpolated percentiles with a least number of samples."""
    return rounded(ag.guarded_percentiles(candidates(spark, d), ["lane"], "score", [10, 15], least=8))


_WQ = "WITH v AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM v), p AS (SELECT *, lag(c) OVER (PARTITION BY l_returnflag ORDER BY v) AS pc, lag(v) OVER (PARTITION BY l_returnflag ORDER BY v) AS pv FROM r), q AS (SELECT p.*, unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS q FROM p)"


@query("q_weighted_quantile", _WQ + " SELECT l_returnflag, q, round(CASE WHEN pc IS NULL THEN v ELSE pv + (v - pv) * (q * total - pc) / (c - pc) END, 4) AS value FROM q WHERE c >= q * total AND (pc IS NULL OR pc < q * total)")
def weighted_quantile(spark, d):
    """A32."""
    return rounded(ag.weighted_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", [0.25, 0.5, 0.75]), 4)


@query("q_correlation", "SELECT l_shipmode, round(covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0), 6) AS r FROM (SELECT *, l_linenumber AS l_shipmode FROM lineitem) GROUP BY l_shipmode")
def correlation(spark, d):
    """Null instead of an error or NaN where there is no variance."""
    return rounded(table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("l_shipmode")).agg(ag.correlation("l_quantity", "l_extendedprice").alias("r")))


_SIZE = "CASE WHEN p_size < 10 THEN 'near' WHEN p_size < 30 THEN 'mid' ELSE 'full_far' END"


@query("q_reference_buckets", f"SELECT coalesce(b, 'all') AS level, count(p_retailprice) AS n, round(avg(p_retailprice), 6) AS mean, min(p_retailprice) AS low, max(p_retailprice) AS high FROM (SELECT {_SIZE} AS b, p_retailprice FROM part) GROUP BY GROUPING SETS ((b), ())")
def reference_buckets(spark, d):
    """Each row in its bucket and in all."""
    rows = table(spark, d, "part").withColumn("b", sc.bucket("p_size", [(10, "near"), (30, "mid")], "full_far"))
    return rounded(ag.bucket_stats(rows, "b", "p_retailprice"))


@query("q_bucket_fallback", f"WITH s AS (SELECT {_SIZE} AS b, p_retailprice FROM part WHERE p_size < 30), w AS (SELECT unnest(['near', 'mid', 'full_far']) AS b) SELECT w.b, coalesce(o.n, a.n) AS n, round(coalesce(o.mean, a.mean), 6) AS mean, coalesce(o.low, a.low) AS low, coalesce(o.high, a.high) AS high, o.n IS NULL AS fell_back FROM w LEFT JOIN (SELECT b, count(*) AS n, avg(p_retailprice) AS mean, min(p_retailprice) AS low, max(p_retailprice) AS high FROM s GROUP BY b) o USING (b), (SELECT count(*) AS n, avg(p_retailprice) AS mean, min(p_retailprice) AS low, max(p_retailprice) AS high FROM s) a")
def bucket_fallback(spark, d):
    """A bucket without rows takes the statistics of all."""
    rows = table(spark, d, "part").filter("p_size < 30").withColumn("b", sc.bucket("p_size", [(10, "near"), (30, "mid")], "full_far"))
    wanted = spark.createDataFrame([("near",), ("mid",), ("full_far",)], "b string")
    return rounded(ag.stats_with_fallback(ag.bucket_stats(rows, "b", "p_retailprice"), wanted, "b"))


@query("q_reason_counts", f"SELECT reason, count(*) AS n FROM (SELECT upper(trim(unnest(reasons))) AS reason FROM {CANDIDATES}) WHERE reason <> '' AND NOT ends_with(reason, '_READY') GROUP BY 1 ORDER BY n DESC, reason LIMIT 8")
def reason_counts(spark, d):
    """The eight most frequent reasons without ready marks."""
    return ag.reason_counts(candidates(spark, d), "reasons", limit=8)


@query("q_reason_rate", f"SELECT lane, round(avg(CASE WHEN list_contains(list_transform(reasons, lambda x: upper(trim(x))), 'FACELINE_REFUSED') THEN 1.0 ELSE 0 END), 6) AS rate FROM {CANDIDATES} GROUP BY lane")
def reason_rate(spark, d):
    """A40."""
    has = F.array_contains(F.transform("reasons", lambda x: F.upper(F.trim(x))), "FACELINE_REFUSED")
    return rounded(candidates(spark, d).groupBy("lane").agg(ag.coverage(has).alias("rate")))


@query("q_status_pivot", f"SELECT lane, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'FAIL') AS fail FROM {CANDIDATES} GROUP BY lane")
def status_pivot(spark, d):
    """A42."""
    return ag.pivot_counts(candidates(spark, d), "lane", "status", ["PASS", "WARN", "FAIL"])


_AXES = ["face", "upper_body", "full_body", "constitution", "skin", "depth_3d"]


@query("q_axis_summary", "SELECT item_id, round(list_avg(x), 6) AS mean, list_min(x) AS least, len(x)::INTEGER AS available FROM (SELECT item_id, list_filter([" + ", ".join(f"scores.{a}" for a in _AXES) + f"], lambda v: v IS NOT NULL) AS x FROM {ITEMS})")
def axis_summary(spark, d):
    """Mean, least and number of a row's axes."""
    return rounded(items(spark, d).select("item_id", ag.axis_summary([f"scores.{a}" for a in _AXES]).alias("s")).select("item_id", "s.*"))


@query(
    "q_method_compare",
    f"WITH r AS (SELECT lane, status, score, image, summary.base_score AS truth FROM {CANDIDATES} WHERE score IS NOT NULL AND isfinite(summary.base_score)), t AS (SELECT lane, quantile_cont(truth, 0.75) AS strong, quantile_cont(truth, 0.25) AS weak FROM r GROUP BY lane), k AS (SELECT r.*, strong, weak, status = 'PASS' AS kept FROM r JOIN t USING (lane)) "
    "SELECT lane, count(*) AS candidates, round(covar_pop(score, truth) / nullif(stddev_pop(score) * stddev_pop(truth), 0), 6) AS score_truth, round(avg(truth) FILTER (coalesce(kept, false)), 6) AS pass_mean, round(avg(truth) FILTER (NOT coalesce(kept, false)), 6) AS blocked_mean, round(avg(truth) FILTER (coalesce(kept, false)) - avg(truth) FILTER (NOT coalesce(kept, false)), 6) AS separation, round(count(*) FILTER (truth >= strong AND NOT coalesce(kept, false)) / nullif(count(*) FILTER (truth >= strong), 0), 6) AS false_block, round(count(*) FILTER (truth <= weak AND coalesce(kept, false)) / nullif(count(*) FILTER (truth <= weak), 0), 6) AS bad_pass FROM k GROUP BY lane",
)
def method_compare(spark, d):
    """A score against a truth proxy: correlation, separation, false blocks and bad passes."""
    rows = candidates(spark, d).select("lane", "status", "score", "image", sc.finite_or_null(F.col("summary.base_score")).alias("truth")).filter("score IS NOT NULL AND truth IS NOT NULL")
    limits = exact_percentiles(rows, ["lane"], "truth", [25, 75]).groupBy("lane").agg(F.max(F.when(F.col("pct") == 25, F.col("value"))).alias("weak"), F.max(F.when(F.col("pct") == 75, F.col("value"))).alias("strong"))
    both = rows.join(limits, "lane").withColumn("kept", F.coalesce(F.col("status") == "PASS", F.lit(False)))
    kept, strong, weak = F.col("kept"), F.col("truth") >= F.col("strong"), F.col("truth") <= F.col("weak")
    passed, blocked = F.avg(F.when(kept, F.col("truth"))), F.avg(F.when(~kept, F.col("truth")))
    return rounded(both.groupBy("lane").agg(F.count("*").alias("candidates"), ag.correlation("score", "truth").alias("score_truth"), passed.alias("pass_mean"), blocked.alias("blocked_mean"), (passed - blocked).alias("separation"), ag.share(F.count_if(strong & ~kept), F.count_if(strong)).alias("false_block"), ag.share(F.count_if(weak & kept), F.count_if(weak)).alias("bad_pass")))


@query("q_provider_groups", f"SELECT provider_name, provider_version, {strip_sql('cache_state')} AS cache_state, count(*) AS n, round(avg(garment_coverage_ratio), 8) AS coverage, round(avg(visible_body_ratio), 8) AS visible, count(*) FILTER (ok) AS ok FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, image ORDER BY loaded_at DESC NULLS LAST, metric_id DESC) AS rn_ FROM parser_metrics) WHERE rn_ = 1) GROUP BY ALL")
def provider_groups(spark, d):
    """Metrics by provider, version and cache state."""
    from plumbline.tables import current_rows

    rows = current_rows(table(spark, d, "parser_metrics"), "metric_id")
    return rounded(rows.groupBy("provider_name", "provider_version", strip("cache_state").alias("cache_state")).agg(F.count("*").alias("n"), F.avg("garment_coverage_ratio").alias("coverage"), F.avg("visible_body_ratio").alias("visible"), F.count_if("ok").alias("ok")), 8)


@query("q_heavy_metrics", "WITH m AS (SELECT metric, value, w FROM (SELECT unnest(['garment', 'neckline', 'visible']) AS metric, unnest([garment_coverage_ratio, neckline_depth_ratio, visible_body_ratio]) AS value, CASE WHEN isfinite(confidence) AND confidence BETWEEN 0 AND 1 THEN confidence END AS w FROM parser_metrics)) SELECT metric, round(sum(value * w) / nullif(sum(w) FILTER (value IS NOT NULL), 0), 6) AS mean, round(avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS presence, count(*) AS n FROM m GROUP BY metric")
def heavy_metrics(spark, d):
    """Exploded metrics with weighted means and presence."""
    w = F.when(~F.isnan("confidence") & F.col("confidence").between(0.0, 1.0), F.col("confidence"))
    names = {"garment": "garment_coverage_ratio", "neckline": "neckline_depth_ratio", "visible": "visible_body_ratio"}
    long = table(spark, d, "parser_metrics").select(w.alias("w"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in names.items()])).alias("m")).select("w", "m.*")
    return rounded(long.groupBy("metric").agg(ag.weighted_mean("value", "w").alias("mean"), ag.coverage(F.col("value").isNotNull()).alias("presence"), F.count("*").alias("n")))


@query("q_registry_counts", f"SELECT kind, name, count(*) AS n FROM (SELECT unnest(['lane', 'status', 'side']) AS kind, unnest([lane, coalesce(status, '(none)'), coalesce({strip_sql('lane_side')}, '(none)')]) AS name FROM {CANDIDATES}) GROUP BY ALL")
def registry_counts(spark, d):
    """Three counts by one pass."""
    none = F.lit("(none)")
    rows = candidates(spark, d).select("lane", F.coalesce("status", none).alias("status"), F.coalesce(strip("lane_side"), none).alias("side"))
    return ag.count_unpivoted(rows, ["lane", "status", "side"], "kind", "name")


@query("q_quota_subset", f"WITH r AS (SELECT lane, summary.base_score AS truth, row_number() OVER (PARTITION BY lane ORDER BY score DESC NULLS LAST, image, run_id) AS rn, count(*) OVER (PARTITION BY lane) AS n FROM {CANDIDATES}) SELECT lane, count(*) AS chosen, round(avg(truth) FILTER (isfinite(truth)), 6) AS truth_mean FROM r WHERE rn <= ceil(n * 0.1) GROUP BY lane")
def quota_subset(spark, d):
    """Measures of the first tenth of every lane."""
    rows = candidates(spark, d).select("lane", "score", "image", "run_id", sc.finite_or_null(F.col("summary.base_score")).alias("truth"))
    ranked = distributed_rank(rows, ["lane"], [F.col("score").desc_nulls_last(), F.col("image"), F.col("run_id")], "rn").join(rows.groupBy("lane").agg(F.count("*").alias("n")), "lane")
    return rounded(ranked.filter(F.col("rn") <= F.ceil(F.col("n") * 0.1)).groupBy("lane").agg(F.count("*").alias("chosen"), F.avg("truth").alias("truth_mean")))
