"""Queries that write with a sink and read back with a source, so that both are checked against the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import documents
from plumbline.plans.base import CANDIDATES, ITEMS, ROUTES, candidates, current_sql, items, routes
from plumbline.plans.registry import query
from plumbline.session import scratch_path
from plumbline.sources import readers, sinks
from plumbline.tables import current_rows, table


@query("q_label_csv", "SELECT run_id AS image, 'PASS' AS expected_status, 2.5e0 AS weight, lower(engine_version) || '|x' AS reasons FROM review_runs WHERE engine_version IS NOT NULL")
def label_csv(spark, d):
    """Labels to CSV and back, lists joined and split."""
    path = scratch_path(spark, "labels-csv")
    rows = table(spark, d, "review_runs").filter("engine_version IS NOT NULL").select(F.col("run_id").alias("image"), F.lit("PASS").alias("expected_status"), F.lit(2.5).alias("weight"), *[F.lit("").alias(c) for c in readers.LABEL_COLUMNS[3:6]], F.array(F.lower("engine_version"), F.lit("x")).alias("must_have_reasons"), F.array().cast("array<string>").alias("must_not_have_reasons"), F.lit("n").alias("notes"))
    sinks.write_label_csv(rows, path, readers.LABEL_COLUMNS)
    return readers.read_label_csv(spark, path).select("image", "expected_status", "weight", F.array_join("must_have_reasons", "|").alias("reasons"))


@query("q_label_bundle", "SELECT run_id AS image, CASE WHEN finished_at IS NULL THEN 'FAIL' ELSE 'PASS' END AS expected_status, 1.0e0 AS weight FROM review_runs")
def label_bundle(spark, d):
    """Bundles of labels as documents of bounded size, and their validated rows."""
    state = F.when(F.col("finished_at").isNull(), "fail").otherwise("pass")
    labels = table(spark, d, "review_runs").select(F.col("run_id").alias("image"), state.alias("status"))
    path = scratch_path(spark, "labels")
    sinks.write_label_bundles(labels, path, readers.LABELS_VERSION)
    return readers.read_label_bundle(spark, path).select("image", "expected_status", "weight")


@query("q_manifest_file", "SELECT lower(run_id) || '.png' AS path_key, threshold_hash AS prompt_id FROM review_runs")
def manifest_file(spark, d):
    """A manifest as documents whose entries are found whatever the shape of their roots."""
    rows = table(spark, d, "review_runs").select(F.struct(F.concat(F.lit("./"), F.upper("run_id"), F.lit(".PNG")).alias("image"), F.col("threshold_hash").alias("prompt_id")).alias("e"))
    path = scratch_path(spark, "manifest")
    documents = rows.groupBy(sinks.part_of("e", rows.count(), 1000)).agg(F.collect_list("e").alias("items"))
    documents.select(F.to_json(F.struct(F.lit("1").alias("version"), "items"))).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_manifest_entries(spark, path).select("path_key", "prompt_id")


@query("q_whole_manifest_file", "SELECT entry_id::VARCHAR AS key, lower(run_id || '/' || image) AS path_key, prompt_id, seed, try_cast(seed AS BIGINT) AS seed_number, seed_unavailable_reason, anchor_source, intended_view FROM input_manifest")
def whole_manifest_file(spark, d):
    """The whole manifest as documents of at most 1,000 entries, written and read by the tasks."""
    fields = ["prompt_id", "seed", "seed_unavailable_reason", "anchor_source", "intended_view"]
    entry = F.struct(F.concat(F.lit("./"), "run_id", F.lit("/"), F.upper("image")).alias("image"), *fields)
    rows = table(spark, d, "input_manifest").select(F.floor(F.col("entry_id") / 1000).alias("part"), F.struct(F.col("entry_id").cast("string").alias("key"), entry.alias("value")).alias("e"))
    documents = rows.groupBy("part").agg(F.map_from_entries(F.collect_list("e")).alias("items"))
    path = scratch_path(spark, "manifests")
    documents.select(F.to_json(F.struct(F.lit("1").alias("version"), "items"))).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_manifest_entries(spark, path).select("key", "path_key", "prompt_id", "seed", "seed_number", *fields[2:])


@query("q_upsert_table", "SELECT run_id, engine_version, rn AS version FROM (SELECT run_id, CASE WHEN hash_even THEN 'new' ELSE engine_version END AS engine_version, CASE WHEN hash_even THEN 2 ELSE 1 END AS rn FROM (SELECT run_id, engine_version, length(run_id) % 2 = 0 OR run_id LIKE '%3' AS hash_even FROM review_runs))")
def upsert_table(spark, d):
    """A keyed table after a load and a change, as its readers see it."""
    path = scratch_path(spark, "keyed")
    rows = table(spark, d, "review_runs").select("run_id", "engine_version", F.lit(1).alias("version"))
    sinks.upsert_table(spark, path, rows, ["run_id"], "version")
    changed = rows.filter((F.length("run_id") % 2 == 0) | F.col("run_id").endswith("3")).select("run_id", F.lit("new").alias("engine_version"), F.lit(2).alias("version"))
    sinks.upsert_table(spark, path, changed, ["run_id"], "version")
    return sinks.read_latest(spark, path)


@query("q_partitioned_write", f"SELECT lane, count(*) AS n, count(score) AS scored FROM {CANDIDATES} GROUP BY lane")
def partitioned_write(spark, d):
    """A folder per lane; reading one of them reads no other."""
    path = scratch_path(spark, "lanes")
    sinks.write_partitioned(candidates(spark, d).select("candidate_id", "lane", "score"), path, ["lane"], files_per_value=3)
    return spark.read.parquet(path).groupBy("lane").agg(F.count("*").alias("n"), F.count("score").alias("scored"))


@query("q_variant_documents", f"SELECT item_id, scores.face AS face, task_profile AS profile FROM {ITEMS}")
def variant_documents(spark, d):
    """Open documents as VARIANT, with paths read as typed columns."""
    doc = F.parse_json(F.to_json(F.struct(F.struct("scores").alias("debug"), F.array(F.struct("task_profile")).alias("list"))))
    rows = items(spark, d).select("item_id", doc.alias("doc"))
    return rows.select("item_id", readers.at_path("doc", "debug.scores.face", "double").alias("face"), readers.at_path("doc", "list.0.task_profile").alias("profile"))


@query("q_cache_table", "SELECT provider_version AS version, count(*) AS n FROM parser_metrics GROUP BY provider_version")
def cache_table(spark, d):
    """A cache appended by version; another version is a miss."""
    path = scratch_path(spark, "cache")
    rows = table(spark, d, "parser_metrics").select("metric_id", "provider_version")
    sinks.append_cache(rows, path, F.col("provider_version"))
    found = spark.read.schema("metric_id bigint, provider_version string, version string").parquet(path)
    return found.groupBy("version").agg(F.count("*").alias("n"))


@query("q_search_aliases", "SELECT route_id, '\"' || coalesce(face_bucket, pose_bucket, face_side) || '\"' AS found FROM view_routes")
def search_aliases(spark, d):
    """The value under the first of several names, wherever a document has one."""
    first = F.struct(F.col("pose_bucket").alias("bucket_name"), F.col("face_bucket").alias("bucket"))
    doc = F.to_json(F.struct(F.array(F.struct(first.alias("meta"), F.struct(F.col("face_side").alias("bucket")).alias("other"))).alias("parts")))
    return table(spark, d, "view_routes").select("route_id", readers.search_aliases(doc, ["bucket", "bucket_name"]).alias("found"))


@query("q_run_snapshots", "SELECT 'run=' || run_id AS run, active_profile AS profile, layer FROM review_runs")
def run_snapshots(spark, d):
    """A snapshot file in each run's folder, found by a pattern and read as open documents."""
    path = scratch_path(spark, "snapshots")
    rows = table(spark, d, "review_runs").select(F.to_json(F.struct("active_profile", F.struct("layer").alias("batch"))).alias("value"), F.col("run_id").alias("run"))
    rows.repartition(F.col("run")).write.partitionBy("run").text(path)
    docs = readers.read_run_snapshots(spark, f"{path}/run=*/*.txt")
    return docs.select("run", readers.at_path("doc", "active_profile").alias("profile"), readers.at_path("doc", "batch.layer").alias("layer"))


_ROLE = "lane || '/' || run_id"


@query("q_anchors_by_role", f"WITH l AS (SELECT DISTINCT {_ROLE} AS role, trim(image) AS path FROM {CANDIDATES} WHERE status = 'FAIL' AND trim(coalesce(image, '')) <> '' AND run_id IS NOT NULL), s AS (SELECT DISTINCT {_ROLE} AS role, trim(image) AS path FROM {CANDIDATES} WHERE run_id IS NOT NULL) SELECT role, path, 'registry' AS source FROM l UNION ALL SELECT role, path, 'folder' FROM s WHERE role NOT IN (SELECT role FROM l)")
def anchors_by_role(spark, d):
    """A role's registered images, else those of its folder."""
    rows = candidates(spark, d).filter("run_id IS NOT NULL").select(F.concat_ws("/", "lane", "run_id").alias("role"), F.trim("image").alias("path"), "status")
    registry = rows.filter("status = 'FAIL'").select("role", "path").distinct()
    return readers.anchors_by_role(registry, rows.select("role", "path").distinct())


@query("q_anchor_pools", f"SELECT lane AS role, r.run_id || '/' || r.image AS path, p.confidence FROM {ROUTES} r JOIN {current_sql('parser_metrics', 'metric_id')} p ON p.run_id = r.run_id AND p.image = r.image WHERE lane IN ('front', 'side_90') AND p.ok")
def anchor_pools(spark, d):
    """The usable anchors of the wanted roles, with their features."""
    path = F.concat_ws("/", "run_id", "image").alias("path")
    registry = routes(spark, d).filter("run_id IS NOT NULL AND image IS NOT NULL").select(F.col("lane").alias("role"), path)
    features = current_rows(table(spark, d, "parser_metrics"), "metric_id").filter("run_id IS NOT NULL AND image IS NOT NULL").select(path, "ok", "confidence")
    return documents.anchor_pools(registry, features, ["front", "side_90"]).select("role", "path", "confidence")
