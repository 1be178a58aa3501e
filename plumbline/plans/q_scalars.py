"""Queries of scalar functions, projections, sources and the plugin surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalars as sc
from plumbline.functions import vectors as vec
from plumbline.functions.provider import Provider, apply_chain, fuse_components
from plumbline.functions.shape import procrustes, topology_signature_of
from plumbline.plans.base import CANDIDATES, ITEMS, ROUTES, candidates, items, rounded, routes
from plumbline.plans.registry import query
from plumbline.sources.readers import at_path, pick
from plumbline.tables import table

_E = "list_filter({c}, lambda x: x IS NOT NULL)"


@query("q_clamp_linear", "SELECT l_orderkey, l_linenumber, greatest(10, least(40, l_quantity)) AS held, CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity >= 40 THEN 1 ELSE (l_quantity - 10) / 30 END AS position FROM lineitem")
def clamp_linear(spark, d):
    """F01, F02."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sc.clamp("l_quantity", 10, 40).alias("held"), sc.linear01("l_quantity", 10, 40).alias("position"))


@query("q_soft_range_score", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity BETWEEN 20 AND 30 THEN 1 ELSE greatest(0, least(1, 1 - (CASE WHEN l_quantity < 20 THEN 20 - l_quantity ELSE l_quantity - 30 END) / 15)) END, 6) AS soft, round(exp(-l_quantity / 25), 6) AS decay, round(CASE WHEN l_quantity <= 10 THEN 1 WHEN l_quantity >= 40 THEN 0.2 ELSE greatest(0.2, 1 - 0.8 * (l_quantity - 10) / 30) END, 6) AS deviation FROM lineitem")
def soft_range(spark, d):
    """F03, F04, F06."""
    rows = table(spark, d, "lineitem")
    return rounded(rows.select("l_orderkey", "l_linenumber", sc.soft_range("l_quantity", 20, 30, 15).alias("soft"), sc.decay("l_quantity", 25).alias("decay"), sc.deviation_score(F.col("l_quantity"), 10, 40).alias("deviation")))


@query("q_range_scores", f"SELECT candidate_id, round(greatest(0, least(1, (score - 0.2) / 0.6)), 6) AS up, round(1 - greatest(0, least(1, (score - 0.2) / 0.6)), 6) AS down FROM {CANDIDATES} WHERE score IS NOT NULL")
def range_scores(spark, d):
    """F05."""
    rows = candidates(spark, d).filter("score IS NOT NULL")
    return rounded(rows.select("candidate_id", sc.range_score(F.col("score"), 0.2, 0.8).alias("up"), sc.inverse_range_score(F.col("score"), 0.2, 0.8).alias("down")))


@query("q_angle_delta", f"SELECT route_id, round(least(abs(body_yaw_deg - 350), abs(360 - abs(body_yaw_deg - 350))), 4) AS delta, round(CASE WHEN abs(body_yaw_deg - 350) > 180 THEN 360 - abs(body_yaw_deg - 350) ELSE abs(body_yaw_deg - 350) END, 4) AS wrapped FROM {ROUTES} WHERE isfinite(body_yaw_deg)")
def angle_delta(spark, d):
    """both rules of wrapping."""
    rows = routes(spark, d).filter(sc.finite_or_null(F.col("body_yaw_deg")).isNotNull())
    return rounded(rows.select("route_id", sc.angle_delta(F.col("body_yaw_deg"), 350.0).alias("delta"), sc.angle_delta_wrapped("body_yaw_deg", 350.0).alias("wrapped")), 4)


@query("q_relative_similarity", f"SELECT item_id, round(greatest(0, least(1, 1 - (abs(scores.face - scores.overall) / greatest(1e-6, abs(scores.face) + abs(scores.overall)) + abs(scores.upper_body - scores.overall) / greatest(1e-6, abs(scores.upper_body) + abs(scores.overall))) / 2)), 6) AS similarity, round(1 / (1 + abs(scores.face - scores.overall) / 0.1), 6) AS reciprocal FROM {ITEMS} WHERE scores.face IS NOT NULL AND scores.overall IS NOT NULL AND scores.upper_body IS NOT NULL")
def relative_similarity(spark, d):
    """F08, F09."""
    rows = items(spark, d).filter("scores.face IS NOT NULL AND scores.overall IS NOT NULL AND scores.upper_body IS NOT NULL")
    return rounded(rows.select("item_id", sc.relative_similarity([("scores.face", "scores.overall"), ("scores.upper_body", "scores.overall")]).alias("similarity"), sc.reciprocal_similarity(F.abs(F.col("scores.face") - F.col("scores.overall")), 0.1).alias("reciprocal")))


_GOOD = "FROM parser_metrics WHERE len(boundary_signature) = 6 AND len(list_filter(boundary_signature, lambda x: isfinite(x))) = 6"
_SHIFT = "list_concat(boundary_signature[2:], [boundary_signature[1]])"


@query("q_vector_functions", f"WITH s AS (SELECT metric_id, list_transform(boundary_signature, lambda x: x::DOUBLE) AS a, list_transform({_SHIFT}, lambda x: x::DOUBLE) AS b {_GOOD}), n AS (SELECT *, sqrt(list_dot_product(a, a)) AS na FROM s) SELECT metric_id, round(CASE WHEN na >= 1e-8 THEN list_dot_product(a, b) / (na * na) END, 6) AS cosine, round(exp(-3 * list_avg(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])))), 6) AS decayed, round(list_sum(list_transform(list_zip(a, b), lambda z: least(z[1], z[2]))), 6) AS common, round(a[1] - list_avg(a), 6) AS first_centred FROM n")
def vector_functions(spark, d):
    """F10, F11, F15, F19 on a signature and the same turned by one place."""
    finite = F.forall("boundary_signature", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table(spark, d, "parser_metrics").filter((F.size("boundary_signature") == 6) & finite)
    a = F.col("boundary_signature")
    b = F.concat(F.slice(a, 2, 5), F.slice(a, 1, 1))
    return rounded(rows.select("metric_id", vec.cosine(a, b).alias("cosine"), vec.decayed_similarity(a, b, 3).alias("decayed"), vec.histogram_intersection(a, b).alias("common"), F.get(vec.centred(a), F.lit(0)).alias("first_centred")))


@query("q_unit_vectors", f"WITH s AS (SELECT metric_id, list_transform(boundary_signature, lambda x: x::DOUBLE) AS a {_GOOD}) SELECT metric_id, round(a[1] / sqrt(list_dot_product(a, a)), 6) AS first FROM s WHERE sqrt(list_dot_product(a, a)) > 1e-8")
def unit_vectors(spark, d):
    """F12."""
    finite = F.forall("boundary_signature", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table(spark, d, "parser_metrics").filter((F.size("boundary_signature") == 6) & finite)
    return rounded(rows.select("metric_id", vec.unit("boundary_signature").alias("u")).filter("u IS NOT NULL").select("metric_id", F.get("u", F.lit(0)).alias("first")))


@query("q_log_ratios", f"WITH k AS (SELECT candidate_id, unnest(['full', 'upper']) AS name, unnest([scores['full'], scores['upper']]) AS c, unnest([confidence['full'], confidence['upper']]) AS r FROM {CANDIDATES}) SELECT candidate_id, round(sum(ln(c / r)), 6) AS total FROM k WHERE c > 0 AND r > 0 GROUP BY candidate_id HAVING count(*) >= 2")
def log_ratios(spark, d):
    """signed log ratios of two maps, with a least number of components."""
    keep = lambda c: F.map_filter(c, lambda k, v: k.isin("full", "upper") & v.isNotNull())
    rows = candidates(spark, d).select("candidate_id", vec.log_ratios(keep("scores"), keep("confidence"), 2).alias("m")).filter("m IS NOT NULL")
    return rounded(rows.select("candidate_id", F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("q_hamming", "SELECT o_orderkey, 1 - bit_count(xor(o_orderkey, o_custkey)) / 64.0::DOUBLE AS similarity FROM orders")
def hamming(spark, d):
    """F18."""
    return table(spark, d, "orders").select("o_orderkey", vec.hamming_similarity("o_orderkey", "o_custkey").alias("similarity"))


@query("q_boxes", "WITH b AS (SELECT l_orderkey, l_linenumber, l_discount AS al, l_tax AS at_, l_discount + 0.06 AS ar, l_tax + 0.06 AS ab, 0.04::DOUBLE AS bl, 0.03::DOUBLE AS bt, 0.09::DOUBLE AS br, 0.1::DOUBLE AS bb FROM lineitem), i AS (SELECT *, greatest(0, least(ar, br) - greatest(al, bl)) * greatest(0, least(ab, bb) - greatest(at_, bt)) AS c FROM b) SELECT l_orderkey, l_linenumber, round(c / ((ar - al) * (ab - at_) + (br - bl) * (bb - bt) - c), 5) AS iou, round(sqrt(((al + ar - bl - br) / 2) ** 2 + ((at_ + ab - bt - bb) / 2) ** 2), 5) AS shift FROM i")
def boxes(spark, d):
    """overlap and shift of boxes."""
    a = [F.col("l_discount"), F.col("l_tax"), F.col("l_discount") + 0.06, F.col("l_tax") + 0.06]
    b = [F.lit(0.04), F.lit(0.03), F.lit(0.09), F.lit(0.1)]
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sc.box_iou(a, b).alias("iou"), sc.box_shift(a, b)["centre"].alias("shift")), 5)


@query("q_geometry", "SELECT l_orderkey, l_linenumber, round(degrees(acos(greatest(-1, least(1, (l_quantity * l_linenumber) / (l_quantity * sqrt(l_linenumber * l_linenumber + 4)))))), 4) AS angle, round(least(l_quantity, l_linenumber) / greatest(l_quantity, l_linenumber), 6) AS balance, round(sqrt((l_quantity - 25) ** 2 + (l_linenumber - 3) ** 2 + 4), 5) AS delta_e FROM lineitem")
def geometry(spark, d):
    """joint angle, balance and colour distance."""
    zero = F.lit(0.0)
    angle = sc.joint_angle("l_quantity", zero, zero, zero, F.col("l_linenumber"), F.lit(2.0))
    colours = sc.colour_distances("l_quantity", "l_linenumber", F.lit(2.0), F.lit(25.0), F.lit(3.0), F.lit(0.0))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(angle, 4).alias("angle"), F.round(sc.balance_ratio("l_quantity", F.col("l_linenumber").cast("double")), 6).alias("balance"), F.round(colours["delta_e"], 5).alias("delta_e"))
    return rows


@query("q_status_band", f"SELECT item_id, CASE WHEN s >= 0.7 THEN 'PASS' WHEN s >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS state, CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN s >= 0.75 THEN 'HIGH' WHEN s >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT item_id, scores.depth_3d AS s FROM {ITEMS})")
def status_band(spark, d):
    """a missing score fails."""
    s = F.col("scores.depth_3d")
    return items(spark, d).select("item_id", sc.status_for(s, 0.7, 0.5).alias("state"), sc.band(s, [(0.75, "HIGH"), (0.5, "MEDIUM")], "LOW", "UNKNOWN").alias("band"))


@query("q_path_tokens", "SELECT entry_id, trim(regexp_replace(lower(image), '[^a-z0-9]+', '_', 'g'), '_') AS token, len(list_filter(regexp_split_to_array(lower(image), '[^a-z0-9]+'), lambda x: x <> ''))::INTEGER AS tokens FROM input_manifest WHERE image IS NOT NULL")
def path_tokens(spark, d):
    """F28."""
    return table(spark, d, "input_manifest").filter("image IS NOT NULL").select("entry_id", sc.token("image").alias("token"), F.size(sc.path_tokens("image")).alias("tokens"))


@query("q_view_family", f"SELECT route_id, CASE WHEN starts_with(dt, 'strict_side_90') OR starts_with(dt, 'side_like') THEN 'side' WHEN dt IN ('strict_back_180', 'back_like') THEN 'back' WHEN dt IN ('front', 'three_quarter') THEN dt WHEN lane = 'side_90' THEN 'side' WHEN lane = 'back_180' THEN 'back' WHEN lane IN ('front', 'three_quarter') THEN lane END AS family FROM (SELECT route_id, lane, coalesce(trim(lane_detail), '') AS dt FROM {ROUTES})")
def view_family(spark, d):
    """F29, F30, J17."""
    return routes(spark, d).select("route_id", sc.view_family("lane_detail", "lane").alias("family"))


@query("q_text_helpers", "SELECT entry_id, coalesce(nullif(trim(seed), ''), nullif(trim(seed_unavailable_reason), ''), 'none') AS first, coalesce(try_cast(seed AS DOUBLE), -1) AS number, CASE WHEN lower(trim(seed)) IN ('1', 'true', 'yes', 'y', 'on') THEN true ELSE false END AS truth FROM input_manifest")
def text_helpers(spark, d):
    """P02, P04, P06."""
    return table(spark, d, "input_manifest").select("entry_id", sc.first_text("seed", "seed_unavailable_reason", F.lit("none")).alias("first"), sc.number_or("seed", -1.0).alias("number"), sc.truth("seed").alias("truth"))


@query("q_finite", "SELECT route_id, CASE WHEN isfinite(confidence) THEN confidence END AS confidence FROM view_routes")
def finite(spark, d):
    """NaN and infinities become null."""
    return table(spark, d, "view_routes").select("route_id", sc.finite_or_null(F.col("confidence")).alias("confidence"))


@query("q_nested_defaults", "SELECT candidate_id, coalesce(shadow_router.lane, lane, 'unknown') AS lane, coalesce(summary.bonus, 0) AS bonus, coalesce(scores['depth_3d'], -1) AS depth FROM anchor_candidates")
def nested_defaults(spark, d):
    """Nested fields with defaults; only the fields asked for are read."""
    return table(spark, d, "anchor_candidates").select("candidate_id", F.coalesce("shadow_router.lane", "lane", F.lit("unknown")).alias("lane"), F.coalesce("summary.bonus", F.lit(0.0)).alias("bonus"), F.coalesce(F.try_element_at("scores", F.lit("depth_3d")), F.lit(-1.0)).alias("depth"))


@query("q_actionable", f"SELECT item_id, status FROM {ITEMS} WHERE status IN ('WARN', 'FAIL') AND coalesce(scores.overall, 0) < 0.6")
def actionable(spark, d):
    """P07, P15."""
    return items(spark, d).filter(F.col("status").isin("WARN", "FAIL") & (F.coalesce("scores.overall", F.lit(0.0)) < 0.6)).select("item_id", "status")


@query("q_digest", "SELECT run_id, 'run_' || left(sha256(coalesce(engine_version, chr(0)) || chr(31) || coalesce(threshold_hash, chr(0))), 16) AS id FROM review_runs")
def digest(spark, d):
    """Stable ids from a hash of the parts."""
    return table(spark, d, "review_runs").select("run_id", sc.stable_id("run_", "engine_version", "threshold_hash").alias("id"))


@query("q_json_path", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_path(spark, d):
    """A field of a JSON document through VARIANT."""
    return table(spark, d, "events").select("event_id", at_path(F.try_parse_json("props"), "k", "int").alias("k"))


@query("q_pick_record", f"SELECT candidate_id, CASE WHEN len(reasons) > 0 THEN reasons[least(2, len(reasons) - 1) + 1] END AS third FROM {CANDIDATES}")
def pick_record(spark, d):
    """An index held within the list."""
    return candidates(spark, d).select("candidate_id", pick("reasons", 2).alias("third"))


@query("q_compact_json", f"SELECT item_id, CASE WHEN scores.depth_3d IS NULL THEN '{{}}' ELSE 'depth' END AS doc FROM {ITEMS}")
def compact_json(spark, d):
    """Null fields are left out of a document."""
    doc = F.to_json(F.struct(F.col("scores.depth_3d").alias("depth")), {"ignoreNullFields": "true"})
    return items(spark, d).select("item_id", F.when(doc == "{}", doc).otherwise("depth").alias("doc"))


@query("q_instant", "SELECT run_id, CASE WHEN hour(started_at) % 2 = 0 THEN epoch_us(started_at) - epoch_us(started_at) % 1000000 END AS micros FROM review_runs")
def instant(spark, d):
    """a time without a zone is none."""
    text = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss")
    zoned = F.when(F.hour("started_at") % 2 == 0, F.concat(text, F.lit("Z"))).otherwise(text)
    return table(spark, d, "review_runs").withColumn("z", zoned).select("run_id", F.unix_micros(sc.utc_instant("z").cast("timestamp")).alias("micros"))


# -- plugins and shapes -----------------------------------------------------------------------------------------------


def _strict(rows):
    """Refuses a batch with a score below zero, as a plugin may."""
    if (rows["score"] < 0).any():
        raise ValueError("negative score")
    return rows.assign(measure=rows["score"] * 2)[["measure"]]


def _mild(rows):
    return rows.assign(measure=rows["score"].abs())[["measure"]]


@query("q_provider_chain", f"SELECT candidate_id, CASE WHEN score >= 0 THEN score * 2 ELSE abs(score) END AS measure, CASE WHEN score >= 0 THEN 'strict' ELSE 'mild' END AS provider FROM {CANDIDATES} WHERE score IS NOT NULL")
def provider_chain(spark, d):
    """A chain of Arrow-batched plugins; the second does what the first refuses."""
    rows = candidates(spark, d).filter("score IS NOT NULL").select("candidate_id", "score")
    chain = [Provider("strict", ["score"], "measure double", _strict), Provider("mild", ["score"], "measure double", _mild)]
    return apply_chain(rows, "candidate_id", chain).select("candidate_id", "measure", "provider")


@query("q_fuse_components", "WITH r AS (SELECT run_id, unnest(['garment', 'visible']) AS metric, unnest([garment_coverage_ratio, visible_body_ratio]) AS value, CASE WHEN isfinite(confidence) AND confidence BETWEEN 0 AND 1 THEN confidence ELSE 0 END AS c FROM parser_metrics) SELECT run_id, metric, round(CASE WHEN sum(c) FILTER (value IS NOT NULL) > 0 THEN sum(value * c) / sum(c) FILTER (value IS NOT NULL) END, 6) AS value, round(avg(c) FILTER (value IS NOT NULL), 6) AS c, count(value) AS components FROM r GROUP BY ALL")
def fuse(spark, d):
    """Components fused by confidence."""
    c = F.when(~F.isnan("confidence") & F.col("confidence").between(0.0, 1.0), F.col("confidence")).otherwise(0.0)
    rows = table(spark, d, "parser_metrics").select("run_id", c.alias("c"), F.explode(F.array(F.struct(F.lit("garment").alias("metric"), F.col("garment_coverage_ratio").alias("value")), F.struct(F.lit("visible").alias("metric"), F.col("visible_body_ratio").alias("value")))).alias("x")).select("run_id", "c", "x.*")
    return rounded(fuse_components(rows, "run_id", "metric", "value", "c"))


@query("q_procrustes")
def shapes(spark, d):
    """Every embedding's 32 points against those of its label's first embedding."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("points"))
    first = rows.groupBy("label").agg(F.min_by("points", "vec_id").alias("reference"))
    return rows.join(first, "label").select("vec_id", procrustes(F.col("reference"), F.col("points")).alias("p")).select("vec_id", "p.*")


@query("q_topology_signature")
def signatures(spark, d):
    """Shape statistics of the embeddings read as 32 points."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("points"))
    return rows.select("vec_id", topology_signature_of(F.col("points")).alias("signature"))
