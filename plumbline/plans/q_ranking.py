"""Queries of rankings and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalars as sc
from plumbline.operators import ranking as rk
from plumbline.operators.running import distributed_rank
from plumbline.plans.base import CANDIDATES, ITEMS, ROUTES, candidates, items, rounded, routes
from plumbline.plans.registry import query
from plumbline.tables import table

_RANKED = f"SELECT candidate_id, run_id, lane, image, status, score, row_number() OVER (PARTITION BY run_id, lane ORDER BY score DESC NULLS LAST, image) AS rank FROM {CANDIDATES}"


@query("q_rank_shortlist", f"SELECT candidate_id, rank, rank <= 5 AS shortlist FROM ({_RANKED})")
def rank_shortlist(spark, d):
    """Null scores last, ties by image."""
    ranked = rk.rank_within(candidates(spark, d), ["run_id", "lane"], "score", "image")
    return ranked.select("candidate_id", F.col("rank").cast("long").alias("rank"), (F.col("rank") <= 5).alias("shortlist"))


@query("q_rank_confidence", f"SELECT candidate_id, row_number() OVER (PARTITION BY run_id, lane ORDER BY score DESC NULLS LAST, coalesce(confidence['full'], 0) DESC, image) AS rank FROM {CANDIDATES}")
def rank_confidence(spark, d):
    """Confidence downward after the score, a missing one as 0."""
    rows = candidates(spark, d).withColumn("c", F.try_element_at("confidence", F.lit("full")))
    return rk.rank_within(rows, ["run_id", "lane"], "score", "image", "c").select("candidate_id", F.col("rank").cast("long").alias("rank"))


@query("q_delta_vs_top", f"WITH r AS ({_RANKED}), t AS (SELECT *, first_value(score) OVER w AS top, nth_value(score, 2) OVER w AS second FROM r WINDOW w AS (PARTITION BY run_id, lane ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT candidate_id, rank, round(score - top, 6) AS delta_top, round(top - second, 6) AS gap_top2, CASE WHEN top - second < 0.005 THEN 3 WHEN top - second < 0.012 THEN 2 ELSE 1 END AS review FROM t")
def delta_vs_top(spark, d):
    """Distances to the first row, and how many rows to look at."""
    rows = rk.with_gaps(candidates(spark, d), ["run_id", "lane"], "score", "image")
    return rounded(rows.select("candidate_id", F.col("rank").cast("long").alias("rank"), "delta_top", "gap_top2", rk.review_window("gap_top2").alias("review")))


_RATIO = "CASE lane WHEN 'front' THEN 0.10 WHEN 'back_180' THEN 0.06 ELSE 0.08 END"


@query(
    "q_quota_pass",
    f"WITH r AS ({_RANKED}), g AS (SELECT *, count(*) OVER (PARTITION BY run_id, lane) AS n, coalesce(score < 0.2, false) AS fails, coalesce(score < 0.5, false) AS guarded FROM r), e AS (SELECT *, NOT fails AND coalesce(status = 'PASS', false) AND NOT guarded AS eligible FROM g), u AS (SELECT *, sum(eligible::INTEGER) OVER (PARTITION BY run_id, lane ORDER BY rank) AS used FROM e) SELECT candidate_id, CASE WHEN fails THEN 'FAIL' WHEN eligible AND used > CASE WHEN n < 8 THEN n ELSE greatest(1, ceil(n * ({_RATIO})::DOUBLE)) END THEN 'WARN' WHEN status = 'PASS' AND guarded THEN 'WARN' ELSE status END AS final_status FROM u",
)
def quota_pass(spark, d):
    """An ordered scan with a quota, as running counts."""
    ratio = F.when(F.col("lane") == "front", 0.10).when(F.col("lane") == "back_180", 0.06).otherwise(0.08)
    return rk.quota_pass(candidates(spark, d), ["run_id", "lane"], "score", "image", "status", F.col("score") < 0.2, F.col("score") < 0.5, ratio).select("candidate_id", "final_status")


@query(
    "q_rank_stability",
    f"WITH r AS ({_RANKED}), t AS (SELECT run_id, lane, score, first_value(score) OVER w AS top, nth_value(score, 2) OVER w AS second FROM r WINDOW w AS (PARTITION BY run_id, lane ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), g AS (SELECT run_id, lane, CASE WHEN max(second) IS NOT NULL THEN max(greatest(0, top - second)) END AS gap, count(*) FILTER (top - score <= 0.015) AS cluster_count FROM t GROUP BY ALL), s AS (SELECT *, CASE WHEN gap IS NOT NULL THEN greatest(0, least(1, gap / 0.03)) END AS stability FROM g) SELECT run_id, lane, round(gap, 6) AS gap, round(stability, 6) AS stability, CASE WHEN stability IS NULL THEN 'UNAVAILABLE' WHEN stability >= 0.7 THEN 'STABLE' WHEN stability >= 0.35 THEN 'CLOSE' ELSE 'TIGHT' END AS band, cluster_count FROM s",
)
def rank_stability(spark, d):
    """W08."""
    return rounded(rk.rank_stability(candidates(spark, d), ["run_id", "lane"], "score", "image"))


@query("q_top_cluster", "SELECT o_orderpriority, count(*) FILTER (top - o_totalprice <= 20000) AS near_top FROM (SELECT o_orderpriority, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_orderpriority) AS top FROM orders) GROUP BY 1")
def top_cluster(spark, d):
    """W08 on prices: rows within a distance of the first; the top is joined, not windowed, so no priority is gathered."""
    orders = table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    top = orders.groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("top"))
    return orders.join(top, "o_orderpriority").groupBy("o_orderpriority").agg(F.count_if(F.col("top") - F.col("o_totalprice") <= 20000).alias("near_top"))


@query("q_best_run", f"SELECT active_profile, run_id FROM (SELECT *, row_number() OVER (PARTITION BY active_profile ORDER BY finished_at IS NULL, epoch_us(finished_at - started_at), run_id) AS rn FROM review_runs) WHERE rn = 1")
def best_run(spark, d):
    """The finished run that took the shortest time."""
    took = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return rk.best_row(table(spark, d, "review_runs"), ["active_profile"], F.col("finished_at").isNull(), took.asc_nulls_last(), "run_id").select("active_profile", "run_id")


@query("q_recent", "SELECT run_id, started_at FROM review_runs ORDER BY started_at DESC NULLS LAST, run_id LIMIT 12")
def recent(spark, d):
    """The latest twelve, a top-k without a full sort."""
    return table(spark, d, "review_runs").select("run_id", "started_at").orderBy(F.col("started_at").desc_nulls_last(), "run_id").limit(12)


@query("q_first_by_status", f"SELECT status, item_id FROM (SELECT status, item_id, row_number() OVER (PARTITION BY status ORDER BY scores.overall DESC NULLS LAST, image, item_id) AS rn FROM {ITEMS}) WHERE rn <= 3")
def first_by_status(spark, d):
    """P14."""
    rows = items(spark, d).select("status", "item_id", F.struct("image", "item_id").alias("tie"), F.col("scores.overall").alias("s"))
    return rk.first_n(rows, ["status"], "s", "tie", 3).select("status", "item_id")


@query("q_better_of", f"SELECT item_id, CASE WHEN scores.upper_body > scores.face THEN 'mirrored' WHEN scores.face IS NULL AND scores.upper_body IS NOT NULL THEN 'mirrored' ELSE 'original' END AS side FROM {ITEMS}")
def better_of(spark, d):
    """The first of two wins ties."""
    return items(spark, d).select("item_id", rk.better_of(F.col("scores.face"), F.col("scores.upper_body")).alias("side"))


_PARTS = [("constitution", "scores.constitution"), ("skin", "scores.skin"), ("depth_3d", "scores.depth_3d")]


@query("q_weakest_part", f"WITH p AS (SELECT item_id, unnest(['constitution', 'skin', 'depth_3d']) AS part, unnest([1, 2, 3]) AS place, unnest([scores.constitution, scores.skin, scores.depth_3d]) AS value FROM {ITEMS}) SELECT item_id, part, value FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY value, place) AS rn FROM p WHERE value IS NOT NULL) WHERE rn = 1")
def weakest_part(spark, d):
    """Within the row, without a shuffle."""
    return items(spark, d).select("item_id", rk.weakest(_PARTS).alias("w")).filter("w.part IS NOT NULL").select("item_id", "w.part", "w.value")


@query("q_softmax_margin", "WITH s AS (SELECT route_id, [lane_scores['front'], lane_scores['three_quarter'], lane_scores['side_90'], lane_scores['back_180']] AS x FROM view_routes WHERE lane_scores['front'] IS NOT NULL AND lane_scores['three_quarter'] IS NOT NULL AND lane_scores['side_90'] IS NOT NULL AND lane_scores['back_180'] IS NOT NULL) SELECT route_id, list_max(x) AS best, round(list_max(x) - list_reverse_sort(x)[2], 6) AS margin, round(exp(x[1] - list_max(x)) / (exp(x[1] - list_max(x)) + exp(x[2] - list_max(x)) + exp(x[3] - list_max(x)) + exp(x[4] - list_max(x))), 6) AS p_front FROM s")
def softmax_margin(spark, d):
    """Margin of the two best lanes and probabilities."""
    lanes = ["front", "three_quarter", "side_90", "back_180"]
    rows = table(spark, d, "view_routes").select("route_id", *[F.try_element_at("lane_scores", F.lit(x)).alias(x) for x in lanes]).na.drop()
    return rounded(rows.select("route_id", sc.softmax_margin(lanes).alias("s")).select("route_id", "s.best", "s.margin", F.get("s.probabilities", F.lit(0)).alias("p_front")))


@query("q_provider_ranking", "WITH p AS (SELECT provider_name, avg(visible_body_ratio) AS visible, avg(garment_coverage_ratio) AS coverage FROM parser_metrics GROUP BY 1) SELECT provider_name, row_number() OVER (ORDER BY visible DESC, provider_name) AS by_visible, row_number() OVER (ORDER BY coverage DESC, provider_name) AS by_coverage FROM p")
def provider_ranking(spark, d):
    """Two orders of a few providers."""
    per = table(spark, d, "parser_metrics").groupBy("provider_name").agg(F.avg("visible_body_ratio").alias("v"), F.avg("garment_coverage_ratio").alias("c"), F.lit(0).alias("g"))
    both = rk.rank_within(rk.rank_within(per, ["g"], "v", "provider_name", name="by_visible"), ["g"], "c", "provider_name", name="by_coverage")
    return both.select("provider_name", F.col("by_visible").cast("long").alias("by_visible"), F.col("by_coverage").cast("long").alias("by_coverage"))


@query("q_largest_entries", f"WITH e AS (SELECT route_id, unnest(map_entries(lane_scores)) AS e FROM {ROUTES}), r AS (SELECT route_id, e.key AS k, e.value AS v, row_number() OVER (PARTITION BY route_id ORDER BY abs(e.value) DESC, e.key) AS rn FROM e WHERE e.value IS NOT NULL) SELECT route_id, k AS second_lane, v AS value FROM r WHERE rn = 2")
def largest_entries(spark, d):
    """The largest entries of a map, within the row."""
    two = rk.largest_entries(F.col("lane_scores"), 2)
    return routes(spark, d).select("route_id", F.get(two, F.lit(1)).alias("e")).filter("e IS NOT NULL").select("route_id", F.col("e.key").alias("second_lane"), F.col("e.value").alias("value"))


@query("q_anchor_sides", f"WITH r AS ({_RANKED.replace('candidate_id, ', 'candidate_id, lane_side, ', 1)}) SELECT lane, coalesce(lane_side, '(none)') AS side, count(*) AS n, min(rank) AS best_rank FROM r WHERE rank <= 10 GROUP BY ALL")
def anchor_sides(spark, d):
    """Sides among the first ten candidates of every run and lane."""
    top = rk.rank_within(candidates(spark, d), ["run_id", "lane"], "score", "image").filter("rank <= 10")
    return top.groupBy("lane", F.coalesce("lane_side", F.lit("(none)")).alias("side")).agg(F.count("*").alias("n"), F.min("rank").cast("long").alias("best_rank"))


@query("q_lane_groups", f"WITH r AS (SELECT lane, image, run_id, route_id, row_number() OVER (PARTITION BY lane ORDER BY coalesce(-conf, -1), route_id) AS rn FROM {ROUTES}), s AS (SELECT lane, count(*) AS size FROM {ROUTES} GROUP BY lane) SELECT s.lane, size, round(size / (SELECT sum(size) FROM s), 6) AS share, array_to_string(list(r.route_id ORDER BY rn), ',') AS examples FROM s JOIN r ON s.lane = r.lane AND rn <= 5 GROUP BY ALL")
def lane_groups(spark, d):
    """Groups by size with the five most confident examples; a missing confidence goes first."""
    groups = rk.groups_with_examples(routes(spark, d), ["lane"], "route_id", "conf")
    return rounded(groups.select("lane", "size", "share", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples")))


@query("q_named_order", f"SELECT item_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE status WHEN 'FAIL' THEN 0 WHEN 'WARN' THEN 1 WHEN 'PASS' THEN 2 ELSE 3 END, scores.overall NULLS FIRST, item_id) AS place FROM {ITEMS}")
def named_order(spark, d):
    """A sheet ordered by the named order of statuses, then the score."""
    order = [rk.by_named_order("status", ["FAIL", "WARN", "PASS"]), F.col("s").asc_nulls_first(), F.col("item_id")]
    return distributed_rank(items(spark, d).select("run_id", "item_id", "status", F.col("scores.overall").alias("s")), ["run_id"], order, "place").select("item_id", "place")


@query("q_compare_top", f"WITH r AS ({_RANKED}) SELECT b.run_id, b.lane, a.image AS top, b.image AS other, b.rank, round(b.score - a.score, 6) AS delta FROM r a JOIN r b ON a.run_id = b.run_id AND a.lane = b.lane WHERE a.rank = 1 AND b.rank BETWEEN 2 AND 3")
def compare_top(spark, d):
    """The first against the second and third."""
    return rounded(rk.compare_top(candidates(spark, d), ["run_id", "lane"], "score", "image").withColumn("rank", F.col("rank").cast("long")))


@query("q_blend_topk", "WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rn FROM lineitem) SELECT l_suppkey, round(0.6 * avg(v) + 0.4 * median(v), 4) AS blend FROM r WHERE rn <= 3 GROUP BY l_suppkey")
def blend_topk(spark, d):
    """The best three of each supplier by a rank filter, then mean and median blended."""
    from plumbline.functions.vectors import blended_top

    best = rk.first_n(table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", "l_suppkey", 3)
    return rounded(best.groupBy("l_suppkey").agg(F.collect_list("l_extendedprice").alias("x")).select("l_suppkey", blended_top("x", 3).alias("blend")), 4)
