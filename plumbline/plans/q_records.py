"""Queries of measures and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import measures as ms
from plumbline.functions.scalars import finite_or_null
from plumbline.operators import records as rc
from plumbline.plans.base import CANDIDATES, ITEMS, MANIFEST, ROUTES, candidates, items, manifest, rounded, routes
from plumbline.plans.registry import query
from plumbline.tables import table

_C = "greatest(0, least(1, {x}))"


@query("q_framing", f"WITH f AS (SELECT route_id, coalesce(head_skin_ratio, 1) AS room, coalesce(mask_symmetry, 0) AS h, coalesce(pose_frontal_strength, 0) AS feet FROM {ROUTES}), s AS (SELECT *, 1 - {_C.format(x='abs(h - 0.82) / 0.22')} AS size, 1 - {_C.format(x='abs(room - 0.07) / 0.12')} AS top FROM f) SELECT route_id, round({_C.format(x='0.4 * feet + 0.35 * size + 0.25 * top')}, 6) AS score, CASE WHEN feet >= 0.5 AND size >= 0.6 AND top >= 0.6 THEN 'FRAMING_OK' ELSE array_to_string(list_filter([CASE WHEN feet < 0.5 THEN 'FEET_CROPPED_OR_NOT_IN_FRAME' END, CASE WHEN size < 0.6 THEN 'SUBJECT_SCALE_OFF' END, CASE WHEN top < 0.6 THEN 'HEADROOM_OFF' END], lambda x: x IS NOT NULL), '|') END AS reasons FROM s")
def framing(spark, d):
    """A score by distances from targets, with reasons."""
    rows = routes(spark, d).select("route_id", ms.framing("mask_symmetry", "head_skin_ratio", "pose_frontal_strength").alias("f"))
    return rounded(rows.select("route_id", "f.score", F.array_join("f.reasons", "|").alias("reasons")))


@query("q_size_tolerances", "SELECT metric_id, CASE WHEN neckline_depth_ratio < 0.012 THEN 'full_far' WHEN neckline_depth_ratio < 0.022 THEN 'mid' WHEN neckline_depth_ratio IS NOT NULL THEN 'near' END AS bucket, CASE WHEN neckline_depth_ratio < 0.012 THEN 16.0e0 WHEN neckline_depth_ratio < 0.022 THEN 13.0e0 WHEN neckline_depth_ratio IS NOT NULL THEN 10.0e0 END AS dark_delta FROM parser_metrics WHERE coalesce(neckline_depth_ratio, 0) >= 0")
def size_tolerances(spark, d):
    """A dimension of three rows as a CASE."""
    rows = table(spark, d, "parser_metrics").filter("coalesce(neckline_depth_ratio, 0) >= 0")
    return rows.select("metric_id", ms.size_tolerances("neckline_depth_ratio").alias("t")).select("metric_id", "t.bucket", "t.dark_delta")


@query("q_view_of_points", "WITH p AS (SELECT vec_id, " + ", ".join(f"embedding[{2 * i + 1}]::DOUBLE AS x{i}, embedding[{2 * i + 2}]::DOUBLE AS y{i}" for i in range(5)) + " FROM embeddings), o AS (SELECT vec_id, (x2 - (x0 + x1) / 2) / greatest(1e-6, sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2)) AS nose, ((x3 + x4) / 2 - (x0 + x1) / 2) / greatest(1e-6, sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2)) AS mouth FROM p) SELECT vec_id, CASE WHEN 0.7 * abs(nose) + 0.3 * abs(mouth) < 0.1 THEN 'front' WHEN 0.7 * abs(nose) + 0.3 * abs(mouth) < 0.28 THEN 'three_quarter' ELSE 'profile_like' END AS bucket, CASE WHEN nose < -0.02 THEN 'left' WHEN nose > 0.02 THEN 'right' ELSE 'unknown' END AS side FROM o")
def view_of_points(spark, d):
    """Bucket and side from five points."""
    points = F.array(*[F.array(*[F.get("embedding", F.lit(2 * i + k)).cast("double") for k in (0, 1)]) for i in range(5)])
    return table(spark, d, "embeddings").select("vec_id", ms.view_of_points(points).alias("v")).select("vec_id", "v.bucket", "v.side")


@query("q_lane_strengths", f"WITH m AS (SELECT item_id, scores.skin * 0.4 AS s, scores.depth_3d * 0.3 AS h, scores.overall * 1.5 AS t FROM {ITEMS}), k AS (SELECT item_id, list_avg(list_filter([{_C.format(x='(0.235 - s) / 0.07')} + 0 * s, {_C.format(x='(0.155 - h) / 0.06')} + 0 * h, {_C.format(x='(0.95 - t) / 0.4')} + 0 * t], lambda x: x IS NOT NULL)) AS p, list_avg(list_filter([{_C.format(x='(s - 0.18) / 0.09')} + 0 * s, {_C.format(x='(h - 0.1) / 0.09')} + 0 * h, {_C.format(x='(t - 0.72) / 0.46')} + 0 * t], lambda x: x IS NOT NULL)) AS f FROM m) SELECT item_id, CASE WHEN p IS NULL AND f IS NULL THEN 'unknown' WHEN p > f + 0.08 THEN 'side_like' ELSE 'frontal_like' END AS bucket, round(coalesce(p, 0), 5) AS profile, round(coalesce(f, 0), 5) AS frontal FROM k")
def lane_strengths(spark, d):
    """Means of what is known of several linear maps."""
    rows = items(spark, d).select("item_id", ms.lane_strengths(F.col("scores.skin") * 0.4, F.col("scores.depth_3d") * 0.3, F.col("scores.overall") * 1.5).alias("s"))
    return rounded(rows.select("item_id", "s.*"), 5)


_PARTS = [("torso", "face", 1), ("torso", "upper_body", 1), ("legs", "full_body", 2), ("legs", "depth_3d", 2), ("frame", "skin", 1)]
_NAMES = ["face", "upper_body", "full_body", "skin", "depth_3d"]


@query("q_part_similarities", "WITH p(part, name, least) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _PARTS) + "), m AS (SELECT item_id, unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) AS name, unnest([" + ", ".join(f"scores.{n}" for n in _NAMES) + f"]) AS candidate FROM {ITEMS}), s AS (SELECT item_id, part, avg(1 / (1 + abs(candidate - 0.8) / 0.1)) AS s, count(candidate) AS n, max(least) AS least FROM m JOIN p USING (name) GROUP BY ALL), w AS (SELECT item_id, max(CASE WHEN part = 'torso' AND n >= least THEN s END) AS torso, max(CASE WHEN part = 'legs' AND n >= least THEN s END) AS legs, max(CASE WHEN part = 'frame' AND n >= least THEN s END) AS frame, avg(n / CASE part WHEN 'frame' THEN 1 ELSE 2 END) AS coverage FROM s GROUP BY item_id) SELECT item_id, round((coalesce(torso * 0.5, 0) + coalesce(legs * 0.3, 0) + coalesce(frame * 0.2, 0)) / ((CASE WHEN torso IS NULL THEN 0 ELSE 0.5 END) + (CASE WHEN legs IS NULL THEN 0 ELSE 0.3 END) + (CASE WHEN frame IS NULL THEN 0 ELSE 0.2 END)), 6) AS mean, round(coverage, 6) AS coverage, CASE WHEN torso IS NULL AND legs IS NULL THEN NULL WHEN legs IS NULL OR torso <= legs THEN 'torso' ELSE 'legs' END AS weakest FROM w")
def part_similarities(spark, d):
    """Similarities of parts, their weighted mean and the weakest structural part."""
    long = items(spark, d).select("item_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"scores.{n}").alias("candidate")) for n in _NAMES])).alias("x")).select("item_id", "x.*", F.lit(0.8).alias("master"), F.lit(0.1).alias("scale"))
    parts = spark.createDataFrame(_PARTS, "part string, name string, least int")
    summary = ms.topology_summary(ms.part_similarities(long, ["item_id"], parts), ["item_id"], {"torso": 0.5, "legs": 0.3, "frame": 0.2}, ["torso", "legs"])
    return rounded(summary.select("item_id", "mean", "coverage", "weakest"))


@query("q_body_ratios", "WITH p AS (SELECT vec_id, embedding AS e FROM embeddings), d AS (SELECT vec_id, sqrt((e[1]::DOUBLE - e[3]::DOUBLE) ** 2 + (e[2]::DOUBLE - e[4]::DOUBLE) ** 2) AS shoulders, sqrt((e[5]::DOUBLE - e[7]::DOUBLE) ** 2 + (e[6]::DOUBLE - e[8]::DOUBLE) ** 2) AS hips, sqrt((e[9]::DOUBLE - e[11]::DOUBLE) ** 2 + (e[10]::DOUBLE - e[12]::DOUBLE) ** 2) AS torso FROM p) SELECT vec_id, round(CASE WHEN torso > 1e-6 THEN shoulders / torso END, 5) AS shoulder_width_to_torso, round(CASE WHEN hips > 1e-6 THEN shoulders / hips END, 5) AS shoulder_to_hip FROM d")
def body_ratios(spark, d):
    """Ratios of distances between named points."""
    names = ["left_shoulder", "right_shoulder", "left_hip", "right_hip", "neck", "mid_hip"]
    point = lambda i: F.array(*[F.get("embedding", F.lit(2 * i + k)).cast("double") for k in (0, 1)])
    joints = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), point(i))])
    rows = table(spark, d, "embeddings").select("vec_id", joints.alias("j")).select("vec_id", ms.body_ratios("j").alias("r"))
    return rounded(rows.select("vec_id", "r.shoulder_width_to_torso", "r.shoulder_to_hip"), 5)


@query("q_feature_channels", "WITH f AS (SELECT vec_id, embedding AS e, vec_id * 7919 AS h FROM embeddings), z AS (SELECT * FROM f WHERE vec_id = 1), d AS (SELECT f.vec_id, list_dot_product(list_transform(f.e, lambda x: x::DOUBLE), list_transform(z.e, lambda x: x::DOUBLE)) / sqrt(list_dot_product(list_transform(f.e, lambda x: x::DOUBLE), list_transform(f.e, lambda x: x::DOUBLE)) * list_dot_product(list_transform(z.e, lambda x: x::DOUBLE), list_transform(z.e, lambda x: x::DOUBLE))) AS c, 1 - bit_count(xor(f.h, z.h)) / 64.0::DOUBLE AS p, f.e[1]::DOUBLE - z.e[1]::DOUBLE AS l, sqrt((f.e[2]::DOUBLE - z.e[2]::DOUBLE) ** 2 + (f.e[3]::DOUBLE - z.e[3]::DOUBLE) ** 2) AS ch FROM f, z) SELECT vec_id, round(greatest(0, least(1, (c - 0.45) / 0.25)), 5) AS embedding, round(p, 5) AS phash, round(greatest(0, least(1, 1 - abs(l) / 18)), 5) AS luma, round(greatest(0, least(1, 1 - ch / 22)), 5) AS chroma FROM d")
def feature_channels(spark, d):
    """Channels of similarity to one reference; a missing channel is null."""
    none = F.lit(None).cast("array<double>")
    e = F.col("embedding")
    feature = F.struct(e.alias("embedding"), none.alias("hog"), none.alias("lbp"), (F.col("vec_id") * 7919).alias("phash"), F.slice(F.transform(e, lambda x: x.cast("double")), 1, 3).alias("lab"), F.lit(0.0).alias("lap_var"), F.lit(0.0).alias("hf_energy"))
    rows = table(spark, d, "embeddings").select("vec_id", feature.alias("a"), F.lit("one").alias("pool"))
    reference = rows.filter("vec_id = 1").select("pool", F.col("a").alias("b"))
    found = rows.join(F.broadcast(reference), "pool").select("vec_id", ms.feature_channels("a", "b").alias("c"))  # one row
    return rounded(found.select("vec_id", "c.embedding", "c.phash", "c.luma", "c.chroma"), 5)


@query("q_cascade", f"SELECT item_id, CASE WHEN coalesce(scores.face < 0.4, false) THEN 'FACE_FIRST' WHEN coalesce(scores.depth_3d < 0.5, false) THEN 'DEPTH' WHEN coalesce(scores.overall >= 0.8, false) THEN 'STRONG' ELSE 'OPEN' END AS reading, coalesce(scores.depth_3d, scores.skin, scores.overall) AS support FROM {ITEMS}")
def cascade(spark, d):
    """An ordered cascade, and fallbacks of a measure."""
    reading = ms.first_that_holds([(F.col("scores.face") < 0.4, "FACE_FIRST"), (F.col("scores.depth_3d") < 0.5, "DEPTH"), (F.col("scores.overall") >= 0.8, "STRONG")], "OPEN")
    return items(spark, d).select("item_id", reading.alias("reading"), *ms.with_fallbacks(support=["scores.depth_3d", "scores.skin", "scores.overall"]))


@query("q_shadow_records", f"WITH a AS (SELECT run_id, lane, max(summary.base_score) AS base, arg_max(coalesce(status, ''), candidate_id) AS contract FROM {CANDIDATES} WHERE isfinite(summary.base_score) GROUP BY ALL), i AS (SELECT candidate_id, run_id, lane, score, coalesce(status, '') AS contract FROM {CANDIDATES}) SELECT candidate_id, CASE WHEN a.run_id IS NULL THEN 'ANCHOR_MISSING' WHEN i.contract IS DISTINCT FROM a.contract THEN 'CONTRACT_DIFFERS' WHEN i.score IS NULL THEN 'NOT_MEASURED' END AS withheld, round(CASE WHEN a.run_id IS NOT NULL AND i.contract IS NOT DISTINCT FROM a.contract THEN abs(i.score - a.base) END, 6) AS residual FROM i LEFT JOIN a USING (run_id, lane)")
def shadow_records(spark, d):
    """Residuals against an anchor, withheld where contracts differ."""
    base = candidates(spark, d).withColumn("b", finite_or_null(F.col("summary.base_score"))).withColumn("contract", F.coalesce("status", F.lit("")))
    anchors = base.filter("b IS NOT NULL").groupBy("run_id", "lane").agg(F.max("b").alias("base"), F.max_by("contract", "candidate_id").alias("contract"))
    rows = base.select("candidate_id", "run_id", "lane", "score", "contract")
    return rounded(rc.shadow_records(rows, anchors, ["run_id", "lane"], F.abs(F.col("score") - F.col("anchor_base")), "contract").select("candidate_id", "withheld", "residual"))


@query("q_review_rows", f"WITH a AS (SELECT run_id, image, NULL::INTEGER AS rank FROM {ITEMS} WHERE status = 'FAIL'), b AS (SELECT run_id, image, (candidate_id % 7)::INTEGER AS rank FROM {CANDIDATES}), u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE run_id NOT IN (SELECT run_id FROM a)) SELECT run_id, image, min(coalesce(rank, 999999)) AS rank FROM u GROUP BY ALL")
def review_rows(spark, d):
    """With a fallback source, each image once, a missing rank last."""
    first = items(spark, d).filter("status = 'FAIL'").select("run_id", "image", F.lit(None).cast("int").alias("rank"))
    return rc.review_rows(first, candidates(spark, d).select("run_id", "image", (F.col("candidate_id") % 7).cast("int").alias("rank")), ["run_id"], "image", "rank")


@query("q_blockers", f"SELECT DISTINCT 'unfinished' AS kind, run_id AS name FROM review_runs WHERE finished_at IS NULL UNION SELECT DISTINCT 'unseeded', run_id FROM {MANIFEST} WHERE coalesce(trim(seed), '') = '' AND coalesce(trim(seed_unavailable_reason), '') = ''")
def blockers(spark, d):
    """What blocks, out of several filters."""
    unseeded = (F.coalesce(F.trim("seed"), F.lit("")) == "") & (F.coalesce(F.trim("seed_unavailable_reason"), F.lit("")) == "")
    return rc.blockers(unfinished=table(spark, d, "review_runs").filter("finished_at IS NULL").select(F.col("run_id").alias("name")), unseeded=manifest(spark, d).filter(unseeded).select(F.col("run_id").alias("name")))


@query("q_comparison_state", "WITH c AS (SELECT run_id, max(engine_version) AS v FROM (SELECT run_id, lower(engine_version) AS engine_version FROM review_runs) WHERE run_id LIKE '%0' GROUP BY 1) SELECT r.run_id, CASE WHEN c.v IS NOT NULL THEN c.v IS NOT DISTINCT FROM r.engine_version END AS applied FROM review_runs r LEFT JOIN c USING (run_id)")
def comparison_state(spark, d):
    """Applied only where the roots are the same."""
    runs = table(spark, d, "review_runs").select("run_id", "engine_version")
    made = runs.filter("run_id LIKE '%0'").select("run_id", F.lower("engine_version").alias("engine_version"))
    return rc.comparison_state(runs, made, "run_id", "engine_version").select("run_id", "applied")


@query("q_whole_comparison_state", "WITH c AS (SELECT run_id, max(collection_meta.layer_key) AS v FROM report_items GROUP BY 1) SELECT r.run_id, CASE WHEN c.v IS NOT NULL THEN c.v IS NOT DISTINCT FROM r.layer END AS applied FROM review_runs r LEFT JOIN c USING (run_id)")
def whole_comparison_state(spark, d):
    """Every run's layer against the one that its items were collected for."""
    made = table(spark, d, "report_items").groupBy("run_id").agg(F.max("collection_meta.layer_key").alias("layer"))
    return rc.comparison_state(table(spark, d, "review_runs").select("run_id", "layer"), made, "run_id", "layer").select("run_id", "applied")


@query("q_auto_labels", f"SELECT m.entry_id, CASE WHEN coalesce(trim(m.anchor_source), '') = '' THEN i.status ELSE m.anchor_source END AS expected_status, CASE WHEN coalesce(trim(m.anchor_source), '') <> '' THEN 'hand' WHEN i.status IS NOT NULL THEN 'report' ELSE 'none' END AS label_source FROM {MANIFEST} m LEFT JOIN {ITEMS} i ON m.run_id = i.run_id AND m.image = i.image")
def auto_labels(spark, d):
    """Blank labels filled from a report."""
    template = manifest(spark, d).select("run_id", "image", "entry_id", F.col("anchor_source").alias("expected_status"))
    return rc.auto_labels(template, items(spark, d).select("run_id", "image", "status"), ["run_id", "image"], F.col("status")).select("entry_id", "expected_status", "label_source")


@query("q_for_each_provider", f"SELECT p AS provider, expected, count(*) AS n FROM (SELECT expected, unnest(['a', 'b', 'c']) AS p FROM {MANIFEST}) GROUP BY ALL")
def for_each_provider(spark, d):
    """Every label once per provider."""
    return rc.for_each_provider(manifest(spark, d), ["a", "b", "c"]).groupBy("provider", "expected").agg(F.count("*").alias("n"))


@query("q_run_states", f"SELECT r.run_id, CASE WHEN coalesce(n, 0) <= 0 THEN 'EMPTY' WHEN n >= 40 THEN 'COMPLETE' ELSE 'PARTIAL' END AS state FROM review_runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM {ITEMS} GROUP BY run_id) USING (run_id)")
def run_states(spark, d):
    """States by counts."""
    counts = items(spark, d).groupBy("run_id").agg(F.count("*").alias("n"))
    return table(spark, d, "review_runs").join(counts, "run_id", "left").select("run_id", rc.state_by_counts(F.col("n"), F.lit(40)).alias("state"))


@query("q_preferred_method", f"WITH s AS (SELECT lane, avg(score) AS ms, avg(summary.base_score) FILTER (isfinite(summary.base_score)) AS mb, stddev_pop(score) AS ss, stddev_pop(summary.base_score) FILTER (isfinite(summary.base_score)) AS sb FROM {CANDIDATES} GROUP BY lane), w AS (SELECT lane, (CASE WHEN ms > mb THEN 0.6e0 ELSE 0 END) + (CASE WHEN sb > ss THEN 0.4e0 ELSE 0 END) AS a, (CASE WHEN mb > ms THEN 0.6e0 ELSE 0 END) + (CASE WHEN ss > sb THEN 0.4e0 ELSE 0 END) AS b FROM s) SELECT lane, a AS score_a, b AS score_b, CASE WHEN a > b THEN 'v1' WHEN b > a THEN 'v2' ELSE 'tie' END AS choice FROM w")
def preferred_method(spark, d):
    """The better of two summaries, measure by measure."""
    rows = candidates(spark, d).withColumn("b", finite_or_null(F.col("summary.base_score")))
    both = rows.groupBy("lane").agg(F.struct(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread")).alias("v1"), F.struct(F.avg("b").alias("mean"), F.stddev_pop("b").alias("spread")).alias("v2"))
    return both.select("lane", rc.preferred("v1", "v2", [("mean", 0.6), ("spread", -0.4)]).alias("p")).select("lane", "p.*")


@query("q_packets", f"WITH r AS (SELECT run_id, item_id, status, row_number() OVER (PARTITION BY run_id ORDER BY scores.overall DESC NULLS LAST, item_id) AS rn FROM {ITEMS}), c AS (SELECT run_id, count(*) AS size, count(*) FILTER (status = 'PASS') AS passed FROM {ITEMS} GROUP BY run_id) SELECT run_id, size, CASE WHEN passed > 0 THEN passed END AS passed, array_to_string(list(r.item_id ORDER BY rn), ',') AS items FROM c JOIN r USING (run_id) WHERE rn <= 3 GROUP BY ALL")
def packets(spark, d):
    """A document per run: size, counts by status, and the first three items."""
    from plumbline.operators.documents import packets as build

    found = build(items(spark, d), ["run_id"], [F.col("scores.overall").desc_nulls_last(), F.col("item_id")], ["item_id", "status"], 3, "status")
    return found.select("run_id", "size", F.try_element_at("counts", F.lit("PASS")).alias("passed"), F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ",").alias("items"))


@query("q_replaced_reasons", f"SELECT candidate_id, len(list_filter(coalesce(reasons, []), lambda x: x IS NOT NULL AND NOT starts_with(x, 'RELIEF'))) + (CASE WHEN score IS NOT NULL THEN 1 ELSE 0 END) AS n FROM {CANDIDATES}")
def replaced_reasons(spark, d):
    """The reasons of one block replaced by a new one."""
    from plumbline.operators.documents import replaced_reason

    new = F.when(F.col("score").isNotNull(), F.lit("RELIEF_RECOMPUTED"))
    return candidates(spark, d).select("candidate_id", F.size(replaced_reason("reasons", "RELIEF", new)).cast("long").alias("n"))


@query("q_master_reference", f"WITH m AS (SELECT median(scores.face) AS face, median(scores.depth_3d) AS depth_3d FROM {ITEMS}) SELECT item_id, round(1 / (1 + abs(scores.face - m.face) / 0.1), 6) AS face, round(1 / (1 + abs(scores.depth_3d - m.depth_3d) / 0.1), 6) AS depth_3d FROM {ITEMS}, m")
def master_reference(spark, d):
    """Items against the medians of all."""
    from plumbline.functions.scalars import reciprocal_similarity
    from plumbline.operators.documents import master_reference as build

    rows = items(spark, d).select("item_id", "scores.face", "scores.depth_3d")
    middle = build(rows, ["face", "depth_3d"])
    return rounded(rows.select("item_id", *[reciprocal_similarity(F.abs(F.col(f) - F.lit(middle[f])), 0.1).alias(f) for f in middle]))


@query("q_masks", "WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INTEGER) AS c FROM embeddings), r AS (SELECT vec_id, [c[1:8], c[9:16], c[17:24], c[25:32]] AS rows_ FROM m), o AS (SELECT vec_id, list_transform(rows_, lambda w: list_sum(list_transform(list_zip(w, list_reverse(w)), lambda z: least(z[1], z[2])))) AS i, list_transform(rows_, lambda w: list_sum(list_transform(list_zip(w, list_reverse(w)), lambda z: greatest(z[1], z[2])))) AS u, list_sum(flatten(rows_)) / 32.0::DOUBLE AS ratio FROM r) SELECT vec_id, ratio, round(CASE WHEN list_sum(u) > 0 THEN list_sum(i) / list_sum(u)::DOUBLE END, 6) AS mirror FROM o")
def masks(spark, d):
    """ratio and mirror symmetry of masks, here the signs of the first 32 coordinates."""
    signs = F.transform("embedding", lambda x: (x > 0).cast("int"))
    rows = table(spark, d, "embeddings").withColumn("mask", F.array(*[F.slice(signs, 8 * i + 1, 8) for i in range(4)]))
    return rounded(rows.select("vec_id", ms.mask_ratio("mask").alias("ratio"), ms.mirror_overlap("mask").alias("mirror")))


_MASK_ROWS = ", ".join(f"c[{8 * i + 1}:{8 * i + 8}]" for i in range(8))


@query("q_whole_masks", f"WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INTEGER) AS c FROM embeddings), r AS (SELECT vec_id, [{_MASK_ROWS}] AS rows_ FROM m), o AS (SELECT vec_id, list_transform(rows_, lambda w: list_sum(list_transform(list_zip(w, list_reverse(w)), lambda z: least(z[1], z[2])))) AS i, list_transform(rows_, lambda w: list_sum(list_transform(list_zip(w, list_reverse(w)), lambda z: greatest(z[1], z[2])))) AS u, list_sum(flatten(rows_)) / 64.0::DOUBLE AS ratio FROM r) SELECT vec_id, ratio, round(CASE WHEN list_sum(u) > 0 THEN list_sum(i) / list_sum(u)::DOUBLE END, 6) AS mirror FROM o")
def whole_masks(spark, d):
    """ratio and mirror symmetry of masks, the signs of all 64 coordinates as 8 rows of 8."""
    signs = F.transform("embedding", lambda x: (x > 0).cast("int"))
    rows = table(spark, d, "embeddings").withColumn("mask", F.array(*[F.slice(signs, 8 * i + 1, 8) for i in range(8)]))
    return rounded(rows.select("vec_id", ms.mask_ratio("mask").alias("ratio"), ms.mirror_overlap("mask").alias("mirror")))


@query("q_replay_plan", f"SELECT lane || '__' || v AS task, lane AS area, v AS variant, CASE WHEN n < 100 THEN 'HIGH' ELSE 'NORMAL' END AS priority FROM (SELECT lane, count(*) AS n, unnest(['baseline', 'softer', 'stricter']) AS v FROM {CANDIDATES} GROUP BY lane)")
def replay_plan(spark, d):
    """A task for every variant of every area."""
    from plumbline.operators.documents import replay_plan as build

    areas = candidates(spark, d).groupBy(F.col("lane").alias("area")).agg(F.count("*").alias("n"))
    return build(areas, ["baseline", "softer", "stricter"], F.when(F.col("n") < 100, "HIGH").otherwise("NORMAL"))
