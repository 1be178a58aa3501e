"""Queries of joins, set operations, upserts and graph checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalars as sc
from plumbline.operators import graph, joins, sets
from plumbline.plans.base import CANDIDATES, ITEMS, MANIFEST, ROUTES, candidates, items, manifest, routes
from plumbline.plans.registry import query
from plumbline.sources.readers import split_by_cache
from plumbline.tables import table

_KEY = "nullif(lower(trim(regexp_replace(replace(trim({c}), '\\', '/'), '^(\\./)+', ''), '/')), '')"
_BASE = "list_last(string_split(" + _KEY + ", '/'))"


@query("q_labels_with_items", f"SELECT m.entry_id, i.item_id, i.status FROM {MANIFEST} m LEFT JOIN {ITEMS} i ON m.run_id = i.run_id AND m.image = i.image")
def labels_with_items(spark, d):
    """Every manifest entry with the last delivered item of its image."""
    return joins.labels_with_items(manifest(spark, d), items(spark, d), ["run_id", "image"], "item_id").select("entry_id", "item_id", "status")


@query("q_missing_labels", f"SELECT run_id, image FROM {ITEMS} i WHERE NOT EXISTS (SELECT 1 FROM input_manifest m WHERE m.run_id = i.run_id AND m.image = i.image)")
def missing_labels(spark, d):
    """Items without a manifest entry."""
    return joins.missing(items(spark, d), table(spark, d, "input_manifest"), ["run_id", "image"]).select("run_id", "image")


@query(
    "q_manifest_fallback_join",
    f"WITH e AS (SELECT entry_id, {_KEY.format(c='image')} AS k, {_BASE.format(c='image')} AS b FROM input_manifest), p AS (SELECT k, max(entry_id) AS entry_id FROM e WHERE k IS NOT NULL GROUP BY k), n AS (SELECT b, max(entry_id) AS entry_id FROM e WHERE b IS NOT NULL GROUP BY b HAVING count(*) = 1), r AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN './' || image WHEN 1 THEN 'In/' || upper(image) ELSE image END AS path FROM report_items) "
    f"SELECT item_id, coalesce(p.entry_id, n.entry_id) AS entry_id, CASE WHEN p.entry_id IS NOT NULL THEN 'path' WHEN n.entry_id IS NOT NULL THEN 'name' END AS matched_by FROM r LEFT JOIN p ON {_KEY.format(c='r.path')} = p.k LEFT JOIN n ON {_BASE.format(c='r.path')} = n.b",
)
def manifest_fallback(spark, d):
    """By normalised path, the last entry winning, else by a base name that one entry has."""
    path = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("./"), "image")).when(F.col("item_id") % 3 == 1, F.concat(F.lit("In/"), F.upper("image"))).otherwise(F.col("image"))
    rows = table(spark, d, "report_items").select("item_id", path.alias("path"))
    found = joins.resolve_by_path_or_name(rows, "path", table(spark, d, "input_manifest").select("entry_id", "image"), "image", "entry_id")
    return found.select("item_id", "entry.entry_id", "matched_by")


@query("q_missing_only_fill", f"SELECT m.entry_id, CASE WHEN coalesce(trim(m.seed), '') = '' AND coalesce(trim(c.new_seed), '') <> '' THEN c.new_seed ELSE m.seed END AS seed, (coalesce(trim(m.seed), '') = '' AND coalesce(trim(c.new_seed), '') <> '')::INTEGER AS filled FROM {MANIFEST} m LEFT JOIN (SELECT run_id, image, candidate_id::VARCHAR AS new_seed FROM {CANDIDATES}) c ON m.run_id = c.run_id AND m.image = c.image")
def missing_only_fill(spark, d):
    """Blank seeds filled from another table, with the number of fields filled."""
    new = candidates(spark, d).select("run_id", "image", F.col("candidate_id").cast("string").alias("seed"))
    return joins.fill_missing(manifest(spark, d), new, ["run_id", "image"], ["seed"]).select("entry_id", "seed", "filled")


@query("q_unmatched_updates", f"SELECT candidate_id FROM {CANDIDATES} c WHERE NOT EXISTS (SELECT 1 FROM input_manifest m WHERE m.run_id = c.run_id AND m.image = c.image)")
def unmatched_updates(spark, d):
    """Updates whose key nothing has."""
    return joins.unmatched(candidates(spark, d), table(spark, d, "input_manifest"), ["run_id", "image"]).select("candidate_id")


@query("q_item_signals", f"SELECT i.item_id, c.candidate_id, r.route_id, i.status, c.lane AS candidate_lane, r.lane AS routed_lane FROM {ITEMS} i JOIN {CANDIDATES} c ON i.run_id = c.run_id AND i.image = c.image JOIN {ROUTES} r ON i.run_id = r.run_id AND i.image = r.image")
def item_signals(spark, d):
    """Items with their candidates and routes; all three meet on one partitioning of the key."""
    keys = ["run_id", "image"]
    c = candidates(spark, d).select(*keys, "candidate_id", F.col("lane").alias("candidate_lane"))
    r = routes(spark, d).select(*keys, "route_id", F.col("lane").alias("routed_lane"))
    return items(spark, d).select(*keys, "item_id", "status").join(c, keys).join(r, keys).select("item_id", "candidate_id", "route_id", "status", "candidate_lane", "routed_lane")


@query("q_against_references", "WITH p AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_partkey <= 25) SELECT q.p_partkey, p.p_partkey AS reference, round(exp(-abs(q.p_retailprice - p.p_retailprice) / 100), 6) AS score FROM part q JOIN p ON q.p_brand = p.p_brand")
def against_references(spark, d):
    """Parts against the reference parts of their brand."""
    from plumbline.plans.base import rounded

    part = table(spark, d, "part")
    held = part.filter("p_partkey <= 25").select("p_brand", F.col("p_partkey").alias("reference"), F.col("p_retailprice").alias("price"))
    score = sc.decay(F.abs(F.col("p_retailprice") - F.col("price")), 100)
    return rounded(joins.against_references(part, held, ["p_brand"], score).select("p_partkey", "reference", "score"))


@query("q_whole_against_references", "WITH p AS (SELECT p_brand, min(p_partkey) AS reference, arg_min(p_retailprice, p_partkey) AS price FROM part GROUP BY p_brand) SELECT q.p_partkey, p.reference, round(exp(-abs(q.p_retailprice - p.price) / 100), 6) AS score FROM part q JOIN p ON q.p_brand = p.p_brand")
def whole_against_references(spark, d):
    """Every part against the reference of its brand, the brand's part of the smallest key."""
    from plumbline.plans.base import rounded

    part = table(spark, d, "part")
    held = part.groupBy("p_brand").agg(F.min("p_partkey").alias("reference"), F.min_by("p_retailprice", "p_partkey").alias("price"))
    score = sc.decay(F.abs(F.col("p_retailprice") - F.col("price")), 100)
    return rounded(joins.against_references(part, held, ["p_brand"], score).select("p_partkey", "reference", "score"))


@query("q_baseline_pairs", "WITH t AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k')::INTEGER % 5 AS h FROM events), b AS (SELECT user_id, arg_min(h, event_id) AS h FROM t WHERE event_type = 'view' GROUP BY user_id) SELECT event_id, CASE WHEN b.user_id IS NULL THEN 'BASELINE_MISSING' WHEN t.h IS DISTINCT FROM b.h THEN 'CONTRACT_DIFFERS' ELSE '' END AS errors FROM t LEFT JOIN b USING (user_id)")
def baseline_pairs(spark, d):
    """Trials with their baseline, and why a pair does not count."""
    trials = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.get_json_object("props", "$.k").cast("int") % 5).alias("h"))
    base = trials.filter("event_type = 'view'").groupBy("user_id").agg(F.min_by("h", "event_id").alias("h"))
    return joins.pair_with_baseline(trials, base, ["user_id"], "h").select("event_id", F.array_join("errors", ",").alias("errors"))


@query(
    "q_contract_compare",
    f"WITH v AS (SELECT provider_name, provider_version, metric_id, run_id, image, cache_state FROM parser_metrics), f AS (SELECT provider_name, max(CASE WHEN provider_version IS NOT NULL THEN provider_version END) AS version, max(cache_state) AS cache FROM v GROUP BY 1), l AS (SELECT provider_name, unnest(['version', 'cache']) AS field, unnest([version, cache]) AS value FROM f), a AS (SELECT * FROM l WHERE provider_name = 'clothparse_b'), b AS (SELECT * FROM l WHERE provider_name = 'clothparse_c') SELECT coalesce(a.field, b.field) AS field, a.value AS reference, b.value AS candidate, CASE WHEN a.value IS NULL AND b.value IS NULL THEN 'UNAVAILABLE' WHEN a.value IS NULL OR b.value IS NULL THEN 'PARTIAL' WHEN a.value = b.value THEN 'MATCH' ELSE 'MISMATCH' END AS state FROM a FULL JOIN b ON a.field = b.field",
)
def contract_compare(spark, d):
    """Two providers' contracts field by field."""
    per = table(spark, d, "parser_metrics").groupBy("provider_name").agg(F.max("provider_version").alias("version"), F.max("cache_state").alias("cache"))
    long = per.select("provider_name", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("version", "cache")])).alias("x")).select("provider_name", "x.*")
    one = lambda name: long.filter(F.col("provider_name") == name).withColumn("axis", F.lit("parser"))
    return joins.compare_fields(one("clothparse_b"), one("clothparse_c"), ["axis"], "field", "value").select("field", "reference", "candidate", "state")


@query("q_first_existing", f"WITH k AS (SELECT DISTINCT lane FROM {CANDIDATES} WHERE status = 'PASS'), a AS (SELECT route_id, unnest([lane, 'side_90', 'front']) AS lane, unnest([0, 1, 2]) AS place FROM {ROUTES}), h AS (SELECT route_id, arg_min(a.lane, place) AS resolved FROM a JOIN k ON a.lane = k.lane GROUP BY route_id) SELECT r.route_id, resolved FROM {ROUTES} r LEFT JOIN h USING (route_id)")
def first_existing(spark, d):
    """The first of several candidate keys that is known."""
    known = candidates(spark, d).filter("status = 'PASS'").select(F.col("lane").alias("key"))
    asked = F.array(F.col("lane"), F.lit("side_90"), F.lit("front"))
    return joins.first_existing(routes(spark, d), asked, known, "key", "route_id").select("route_id", "resolved")


@query("q_unique_stems", f"WITH a AS (SELECT regexp_replace(lower(image), '\\.[a-z0-9]+$', '') AS stem, min(entry_id) AS entry_id FROM input_manifest GROUP BY 1 HAVING count(*) = 1), b AS (SELECT regexp_replace(lower(image), '\\.[a-z0-9]+$', '') AS stem, min(item_id) AS item_id FROM report_items GROUP BY 1 HAVING count(*) = 1) SELECT stem, entry_id, item_id FROM a JOIN b USING (stem)")
def unique_stems(spark, d):
    """Files matched by a stem that is unique on both sides."""
    left = table(spark, d, "input_manifest").select("entry_id", sc.stem("image").alias("s"))
    right = table(spark, d, "report_items").select("item_id", sc.stem("image").alias("s"))
    return joins.unique_stem_pairs(left, "s", right, "s").select("stem", "left.entry_id", "right.item_id")


@query("q_fallback_filter", "WITH l AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal > 8000 THEN 0 WHEN s_acctbal > 4000 THEN 1 WHEN s_acctbal > 0 THEN 2 END AS level FROM supplier), m AS (SELECT s_nationkey, min(level) AS least FROM l GROUP BY 1) SELECT s_suppkey, level FROM l JOIN m USING (s_nationkey) WHERE level = least")
def fallback_filter(spark, d):
    """Of each group the best level that it has."""
    b = F.col("s_acctbal")
    level = F.when(b > 8000, 0).when(b > 4000, 1).when(b > 0, 2)
    return joins.with_fallback_levels(table(spark, d, "supplier"), ["s_nationkey"], level).select("s_suppkey", "level")


@query("q_fallback_union", f"WITH a AS (SELECT run_id, lane, count(*) AS n FROM {CANDIDATES} WHERE status = 'FAIL' GROUP BY ALL), b AS (SELECT run_id, lane, count(*) AS n FROM {ROUTES} GROUP BY ALL) SELECT run_id, lane, n FROM a UNION ALL SELECT run_id, lane, n FROM b WHERE run_id NOT IN (SELECT run_id FROM a)")
def fallback_union(spark, d):
    """Counts of one source, and of another for the runs that the first lacks."""
    first = candidates(spark, d).filter("status = 'FAIL'").groupBy("run_id", "lane").agg(F.count("*").alias("n"))
    second = routes(spark, d).groupBy("run_id", "lane").agg(F.count("*").alias("n"))
    return joins.union_unless_empty(first, second, ["run_id"])


@query("q_upsert_latest", "WITH u AS (SELECT run_id, image, item_id, loaded_at, status, item_id % 4 = 0 AS change FROM report_items) SELECT run_id, image, item_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, image ORDER BY loaded_at DESC NULLS LAST, change DESC, item_id DESC) AS rn FROM u) WHERE rn = 1")
def upsert_latest(spark, d):
    """A keyed table after changes."""
    rows = table(spark, d, "report_items").select("run_id", "image", "item_id", F.struct("loaded_at", (F.col("item_id") % 4 == 0).alias("change"), "item_id").alias("version"))
    change = F.col("item_id") % 4 == 0
    return joins.upsert(rows.filter(~change), rows.filter(change), ["run_id", "image"], "version").select("run_id", "image", "item_id")


@query("q_resume_antijoin", "WITH p AS (SELECT DISTINCT user_id, event_type FROM events), f AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 150) SELECT user_id, event_type FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = p.user_id AND f.event_type = p.event_type)")
def resume_antijoin(spark, d):
    """§2.11 (a): the planned work that no finished one matches."""
    events = table(spark, d, "events")
    return joins.unfinished(events.select("user_id", "event_type").distinct(), events.filter("value > 150"), ["user_id", "event_type"])


@query("q_until_failure", "WITH s AS (SELECT user_id, min(event_id) AS stop FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, event_id FROM events LEFT JOIN s USING (user_id) WHERE stop IS NULL OR event_id <= stop")
def until_failure(spark, d):
    """§2.11 (b): the steps up to the first failed one."""
    return joins.until_first_failure(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "error").select("user_id", "event_id")


@query("q_cache_hits", "WITH c AS (SELECT run_id, image, max(confidence) AS confidence FROM parser_metrics WHERE provider_version = '1.1' AND NOT isnan(confidence) GROUP BY ALL) SELECT r.run_id, count(c.image) AS hits, count(*) - count(c.image) AS misses FROM (SELECT DISTINCT run_id, image FROM report_items) r LEFT JOIN c USING (run_id, image) GROUP BY r.run_id")
def cache_hits(spark, d):
    """Rows with a cached result of the wanted version, and those to compute."""
    cache = table(spark, d, "parser_metrics").filter(~F.isnan("confidence")).groupBy("run_id", "image", F.col("provider_version").alias("version")).agg(F.max("confidence").alias("confidence"))
    hits, misses = split_by_cache(table(spark, d, "report_items").select("run_id", "image").distinct(), cache, ["run_id", "image"], "1.1")
    both = hits.select("run_id", F.lit(1).alias("hit")).unionByName(misses.select("run_id", F.lit(0).alias("hit")))
    return both.groupBy("run_id").agg(F.sum("hit").alias("hits"), F.count_if(F.col("hit") == 0).alias("misses"))


@query("q_preflight_mismatch", f"SELECT i.run_id, i.image, i.status AS item_status, c.status AS candidate_status FROM {ITEMS} i JOIN {CANDIDATES} c ON i.run_id = c.run_id AND i.image = c.image WHERE i.status <> '' AND c.status <> '' AND i.status <> c.status ORDER BY i.run_id, i.image LIMIT 20")
def preflight_mismatch(spark, d):
    """The first twenty images whose two statuses are known and differ."""
    mine, other = items(spark, d).select("run_id", "image", F.col("status").alias("item_status")), candidates(spark, d).select("run_id", "image", F.col("status").alias("candidate_status"))
    known = (F.col("item_status") != "") & (F.col("candidate_status") != "") & (F.col("item_status") != F.col("candidate_status"))
    return mine.join(other, ["run_id", "image"]).filter(known).orderBy("run_id", "image").limit(20)


# -- sets -------------------------------------------------------------------------------------------------------------


@query("q_dedupe_ordered", f"WITH e AS (SELECT candidate_id, trim(unnest(reasons)) AS r, generate_subscripts(reasons, 1) AS p FROM {CANDIDATES}), f AS (SELECT candidate_id, r, min(p) AS p FROM e WHERE r <> '' GROUP BY ALL) SELECT c.candidate_id, coalesce(array_to_string(list(f.r ORDER BY f.p) FILTER (f.r IS NOT NULL), '|'), '') AS reasons FROM {CANDIDATES} c LEFT JOIN f USING (candidate_id) GROUP BY c.candidate_id")
def dedupe_ordered(spark, d):
    """Distinct reasons in the order of their first occurrence, within the row."""
    return candidates(spark, d).select("candidate_id", F.array_join(sets.ordered_distinct("reasons"), "|").alias("reasons"))


_CLEAN = "list_filter(list_transform(coalesce({c}, []), lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '')"


@query("q_reason_constraints", f"SELECT candidate_id, len(list_filter(['FACELINE_STEADY', 'HANDS_DRIFTING'], lambda x: NOT list_contains({_CLEAN.format(c='reasons')}, x)))::INTEGER AS missing, len(list_filter(['FACELINE_REFUSED', 'HANDS_REFUSED'], lambda x: list_contains({_CLEAN.format(c='reasons')}, x)))::INTEGER AS unexpected FROM {CANDIDATES}")
def reason_constraints(spark, d):
    """Reasons that must be there and are not, and that must not and are."""
    must, must_not = F.array(F.lit("FACELINE_STEADY"), F.lit("HANDS_DRIFTING")), F.array(F.lit("FACELINE_REFUSED"), F.lit("HANDS_REFUSED"))
    return candidates(spark, d).select("candidate_id", F.size(sets.must_have_missing(must, "reasons")).alias("missing"), F.size(sets.must_not_have_found(must_not, "reasons")).alias("unexpected"))


@query("q_append_unique", f"SELECT item_id, len(list_distinct(list_concat({_CLEAN.format(c='reasons')}, {_CLEAN.format(c='recommendations')})))::INTEGER AS n FROM {ITEMS}")
def append_unique(spark, d):
    """The union of two lists."""
    return items(spark, d).select("item_id", F.size(sets.append_unique("reasons", "recommendations")).alias("n"))


@query("q_first_wins", f"SELECT candidate_id, coalesce(scores['full'], confidence['full']) AS f, coalesce(scores['depth_3d'], confidence['depth_3d']) AS dep FROM {CANDIDATES} WHERE scores IS NOT NULL")
def first_wins(spark, d):
    """The union of two maps, the first one's values winning; null values do not hide the other map's."""
    scores = F.map_filter("scores", lambda _, v: v.isNotNull())
    rows = candidates(spark, d).filter("scores IS NOT NULL").withColumn("m", sets.first_wins(scores, "confidence"))
    return rows.select("candidate_id", F.try_element_at("m", F.lit("full")).alias("f"), F.try_element_at("m", F.lit("depth_3d")).alias("dep"))


@query("q_union_tasks", f"SELECT 'candidate' AS area, lane, count(*) AS n FROM {CANDIDATES} WHERE status = 'FAIL' GROUP BY lane UNION ALL SELECT 'route', lane, count(*) FROM {ROUTES} WHERE conf IS NULL GROUP BY lane")
def union_tasks(spark, d):
    """Tasks of several producers."""
    a = candidates(spark, d).filter("status = 'FAIL'").groupBy("lane").agg(F.count("*").alias("n")).select(F.lit("candidate").alias("area"), "lane", "n")
    b = routes(spark, d).filter("conf IS NULL").groupBy("lane").agg(F.count("*").alias("n")).select(F.lit("route").alias("area"), "lane", "n")
    return a.unionByName(b)


# -- graphs -----------------------------------------------------------------------------------------------------------

_EDGES = "(SELECT DISTINCT 'c' || l_suppkey % 40 AS source_id, 'c' || l_partkey % 60 AS target_id FROM lineitem WHERE l_suppkey % 40 < l_partkey % 60 AND l_orderkey % 97 = 0 UNION SELECT 'c58', 'c41' UNION SELECT 'c41', 'c58' UNION SELECT 'x1', 'c3' UNION SELECT 'c3', 'x2')"
_NODES = "(SELECT 'c' || unnest(range(60)) AS node_id)"


def _graph(spark, d):
    a, b = F.col("l_suppkey") % 40, F.col("l_partkey") % 60
    rows = table(spark, d, "lineitem").filter((a < b) & (F.col("l_orderkey") % 97 == 0)).select(F.concat(F.lit("c"), a.cast("string")).alias("source_id"), F.concat(F.lit("c"), b.cast("string")).alias("target_id"))
    more = spark.createDataFrame([("c58", "c41"), ("c41", "c58"), ("x1", "c3"), ("c3", "x2")], "source_id string, target_id string")
    return spark.range(60).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("node_id")), rows.unionByName(more).distinct()


@query("q_dangling_edges", f"WITH e AS {_EDGES}, n AS {_NODES} SELECT DISTINCT CASE WHEN source_id NOT IN (SELECT node_id FROM n) THEN 'SOURCE_MISSING' ELSE 'TARGET_MISSING' END AS issue, CASE WHEN source_id NOT IN (SELECT node_id FROM n) THEN source_id ELSE target_id END AS node_id FROM e WHERE source_id NOT IN (SELECT node_id FROM n) OR target_id NOT IN (SELECT node_id FROM n)")
def dangling_edges(spark, d):
    """Edges to or from what is no node."""
    return graph.dangling_edges(*_graph(spark, d))


@query("q_cycle_check", f"WITH RECURSIVE e AS {_EDGES}, n AS {_NODES}, v AS (SELECT * FROM e WHERE source_id IN (SELECT node_id FROM n) AND target_id IN (SELECT node_id FROM n)), r(s, t) AS (SELECT source_id, target_id FROM v UNION SELECT r.s, v.target_id FROM r JOIN v ON r.t = v.source_id), c AS (SELECT s FROM r WHERE s = t) SELECT s AS node_id FROM c UNION SELECT t FROM r WHERE s IN (SELECT s FROM c)")
def cycle_check(spark, d):
    """Nodes on a cycle or behind one, by peeling off the others."""
    return graph.nodes_on_or_behind_cycles(*_graph(spark, d))


@query("q_ancestors", f"WITH RECURSIVE e AS {_EDGES}, r(node_id, ancestor_id, distance) AS (SELECT target_id, source_id, 1 FROM e UNION SELECT r.node_id, e.source_id, r.distance + 1 FROM r JOIN e ON r.ancestor_id = e.target_id WHERE r.distance < 62) SELECT node_id, ancestor_id, min(distance)::INTEGER AS distance FROM r GROUP BY ALL")
def ancestors(spark, d):
    """What every node derives from, with the least distance."""
    return graph.ancestors(_graph(spark, d)[1], 70)


# The three above stand on a sample, as their SQL does; these are over all of lineitem, and every supplier and part is a node.
_MORE = [("c58", "c41"), ("c41", "c58"), ("x1", "c3"), ("c3", "x2")]
_ALL_EDGES = "(SELECT 'c' || l_suppkey AS source_id, 'c' || l_partkey AS target_id FROM lineitem UNION " + " UNION ".join(f"SELECT '{a}', '{b}'" for a, b in _MORE) + ")"
_ALL_NODES = "(SELECT 'c' || s_suppkey AS node_id FROM supplier UNION SELECT 'c' || p_partkey FROM part)"


def _whole_graph(spark, d):
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    edges = table(spark, d, "lineitem").select(name("l_suppkey").alias("source_id"), name("l_partkey").alias("target_id"))
    more = spark.createDataFrame(_MORE, "source_id string, target_id string")
    nodes = table(spark, d, "supplier").select(name("s_suppkey").alias("node_id")).unionByName(table(spark, d, "part").select(name("p_partkey").alias("node_id")))
    return nodes.distinct(), edges.unionByName(more)  # an edge may come twice


@query("q_whole_dangling_edges", f"WITH e AS {_ALL_EDGES}, n AS {_ALL_NODES} SELECT DISTINCT CASE WHEN a.node_id IS NULL THEN 'SOURCE_MISSING' ELSE 'TARGET_MISSING' END AS issue, CASE WHEN a.node_id IS NULL THEN source_id ELSE target_id END AS node_id FROM e LEFT JOIN n a ON source_id = a.node_id LEFT JOIN n b ON target_id = b.node_id WHERE a.node_id IS NULL OR b.node_id IS NULL")
def whole_dangling_edges(spark, d):
    """Edges of the whole table to or from what is no node."""
    return graph.dangling_edges(*_whole_graph(spark, d))


@query("q_whole_cycle_check")
def whole_cycle_check(spark, d):
    """Nodes of the whole table on a cycle or behind one. Recursive SQL would list all pairs, so there is none."""
    return graph.nodes_on_or_behind_cycles(*_whole_graph(spark, d))


@query("q_whole_ancestors")
def whole_ancestors(spark, d):
    """What every node of the whole table derives from; up to suppliers times parts rows, by its meaning."""
    return graph.ancestors(_whole_graph(spark, d)[1], 70)
