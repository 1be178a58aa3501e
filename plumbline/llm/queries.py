"""The queries p1 to p9 with their SQL, where SQL can say it over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, clusters, cutoff, neighbours, packing, percentiles, subjects, termcounts, topn
from plumbline.llm.signatures import scaled_parts, unit_vectors, usable_signatures
from plumbline.session import materialize
from plumbline.tables import current_rows, lane, status, strip, table, usable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _current_sql(name: str, row_id: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, image ORDER BY loaded_at DESC NULLS LAST, {row_id} DESC) AS rn_ FROM {name}) WHERE rn_ = 1)"


_LANE_SQL = "coalesce(nullif(translate(lower(trim(lane, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))), ' -', '__'), ''), 'unknown')"
_STATUS_SQL = "upper(trim(status, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)))"


# -- p1, p2 -----------------------------------------------------------------------------------------------------------

_SIGNATURES = {"boundary_signature": 6, "visible_body_signature": 5}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parser_metrics").select("run_id", "image", "metric_id", "loaded_at", *_SIGNATURES)
    return materialize(unit_vectors(current_rows(rows, "metric_id"), "metric_id", _SIGNATURES), "signatures")


_UNIT = scaled_parts(tuple(_SIGNATURES.values()))


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parser_metrics").select("run_id", "image", "metric_id", "loaded_at", *_SIGNATURES)
    return materialize(usable_signatures(current_rows(rows, "metric_id"), "metric_id", _SIGNATURES), "signatures")


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one row is among the ten most similar of the other, at a similarity of 0.999998 or more."""
    near = neighbours.nearest_neighbours(_delivered(spark, sf_dir), 10, unit=_UNIT).filter("similarity >= 0.999998")
    return near.select(F.least("id", "neighbour").alias("metric_id_a"), F.greatest("id", "neighbour").alias("metric_id_b")).distinct()


@query()
def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar rows of every row, with their similarity."""
    near = neighbours.nearest_neighbours(_delivered(spark, sf_dir), 10, unit=_UNIT)
    return near.select(F.col("id").alias("metric_id"), F.col("neighbour").alias("neighbour_id"), "similarity")


@query()
def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the true ten most similar rows that the forest finds, over the rows whose id is divisible by 50."""
    vectors = _delivered(spark, sf_dir)
    exact = neighbours.exact_neighbours(vectors, vectors.filter("id % 50 = 0"), 10, unit=_UNIT)
    near = neighbours.nearest_neighbours(vectors, 10, unit=_UNIT)
    both = exact.join(near.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), F.try_divide(F.count("hit"), F.count("*")).alias("recall"))


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the groups of at least 8 rows that similarities of 0.9999 or more hold together."""
    return clusters.cluster_members(_vectors(spark, sf_dir), 0.9999, 8).select("cluster_id", F.col("id").alias("metric_id"))


@query()
def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every such group with its size and the members of its densest cell."""
    vectors = _vectors(spark, sf_dir)
    members = materialize(clusters.cluster_members(vectors, 0.9999, 8), "members")
    return clusters.describe_clusters(members, vectors, 0.9999)


# -- p3 ---------------------------------------------------------------------------------------------------------------

_TERMS = {"anchor_candidates": "candidate_id", "view_routes": "route_id"}


def _term_store(spark: SparkSession, sf_dir: str) -> tuple[termcounts.TermCounts, DataFrame]:
    """The counts after two merges: the rows loaded up to 30 days before the last load, then what changed since."""
    changes = None
    for origin, row_id in _TERMS.items():
        rows = table(spark, sf_dir, origin)
        last = rows.agg(F.max("loaded_at")).first()[0]
        cut = F.lit(last).cast(rows.schema["loaded_at"].dataType) - F.expr("INTERVAL 30 DAYS")  # null where nothing is loaded
        own = termcounts.deliveries_as_changes(rows, row_id, "reasons", cut).withColumn("origin", F.lit(origin))
        changes = own if changes is None else changes.unionByName(own)
    # the number of current rows is one more counter, kept under a term that no element can be
    counted = changes.withColumn("terms", F.concat("terms", F.array(F.lit(""))))
    deltas = termcounts.term_deltas(counted, "terms", "sign", ("origin", "batch"))
    deltas = materialize(deltas, "term-deltas")
    # the second merge takes up what the first one saved, as another day's run would
    first = termcounts.TermCounts(spark, buckets=termcounts.buckets_for(deltas.count()))
    saved = first.merge(deltas.filter("batch = 0").drop("batch"), written=True).save()
    store = termcounts.TermCounts.open(spark, saved).merge(deltas.filter("batch = 1").drop("batch"), written=True)
    counts = store.counts()
    totals = counts.filter("term = ''").select("origin", F.col("records").alias("n_records"))
    return store, termcounts.mark_terms(counts.filter("term <> ''"), totals)


def _terms_sql(select: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{o}' AS origin, {i} AS id, upper(trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))) AS term FROM (SELECT {i}, unnest(reasons) AS x FROM {_current_sql(o, i)})" for o, i in _TERMS.items())
    totals = " UNION ALL ".join(f"SELECT '{o}' AS origin, count(*) AS n_records FROM {_current_sql(o, i)}" for o, i in _TERMS.items())
    return f"WITH e AS ({parts}), t AS ({totals}), c AS (SELECT origin, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM e WHERE term IS NOT NULL AND term <> '' GROUP BY origin, term), m AS (SELECT c.*, n_records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.6 * n_records THEN 'common' ELSE 'useful' END AS mark FROM c JOIN t USING (origin)) {select}"


@query(_terms_sql("SELECT origin, term FROM m WHERE mark <> 'useful'"))
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of at most 2 current rows, or of more than 60 % of them."""
    return _term_store(spark, sf_dir)[1].filter("mark <> 'useful'").select("origin", "term")


@query(_terms_sql("SELECT origin, term, occurrences, records, mark FROM m"))
def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, current rows and mark."""
    return _term_store(spark, sf_dir)[1].select("origin", "term", "occurrences", "records", "mark")


# -- p4 ---------------------------------------------------------------------------------------------------------------

_FIELDS = {"view_routes": ("route_id", "confidence", 0.0, 1.0), "anchor_candidates": ("candidate_id", "candidate_score", -2.0, 2.0)}
_PERCENTS = (10, 25, 50, 75, 90, 99)


def _field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, run_id, lane, value of the usable values of current rows; written once, read by every pass."""
    found = None
    for name, (row_id, field, low, high) in _FIELDS.items():
        rows = current_rows(table(spark, sf_dir, name).select("run_id", "image", row_id, "loaded_at", "lane", field), row_id)
        rows = rows.filter(usable(field, low, high)).select(F.lit(field).alias("field_name"), "run_id", lane().alias("lane"), F.col(field).alias("value"))
        found = rows if found is None else found.unionByName(rows)
    return materialize(found, "field-values")


def _percentiles(spark: SparkSession, sf_dir: str, percents: tuple[int, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The values; percentiles by field, run and lane; by field and lane, the runs' sketches merged."""
    values = _field_values(spark, sf_dir)
    fine, coarse = ["field_name", "run_id", "lane"], ["field_name", "lane"]
    runs = materialize(percentiles.sketch_values(values, fine, "value"), "run-sketches")
    lanes = percentiles.merge_sketches(runs, coarse)
    return values, percentiles.read_percentiles(runs, fine, percents), percentiles.read_percentiles(lanes, coarse, percents)


_VALUES_SQL = " UNION ALL ".join(f"SELECT '{f}' AS field_name, run_id, {_LANE_SQL} AS lane, {f} AS value FROM {_current_sql(t, i)} WHERE {f} IS NOT NULL AND NOT isnan({f}) AND {f} BETWEEN {lo} AND {hi}" for t, (i, f, lo, hi) in _FIELDS.items())


@query(
    f"WITH v AS ({_VALUES_SQL}), p AS (SELECT unnest([50, 90])::INTEGER AS pct), "
    "r AS (SELECT field_name, run_id, lane, count(*) AS n, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.9) AS q90 FROM v GROUP BY ALL), "
    "l AS (SELECT field_name, lane, quantile_cont(value, 0.5) AS l50, quantile_cont(value, 0.9) AS l90 FROM v GROUP BY ALL) "
    "SELECT field_name, run_id, lane, pct FROM r JOIN l USING (field_name, lane) CROSS JOIN p WHERE n >= 40 AND CASE pct WHEN 50 THEN q50 <= l50 - 0.2 ELSE q90 <= l90 - 0.2 END"
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and lanes of at least 40 values whose 50th or 90th percentile lies 0.20 or more below the lane's.

    The sketches give every percentile with a bracket; those of groups that had to collapse buffers are then made exact
    by counting within the bracket.
    """
    values, runs, lanes = _percentiles(spark, sf_dir, (50, 90))
    exact_runs = percentiles.refine(values, runs.filter("n >= 40"), ["field_name", "run_id", "lane"], "value")
    exact_lanes = percentiles.refine(values, lanes, ["field_name", "lane"], "value").select("field_name", "lane", "pct", F.col("value").alias("lane_value"))
    low = exact_runs.join(exact_lanes, ["field_name", "lane", "pct"]).filter(F.col("value") <= F.col("lane_value") - 0.2)
    return low.select("field_name", "run_id", "lane", "pct")


@query()
def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per lane (run_id null) and per run and lane, straight from the sketches, with the bound on their rank error."""
    _, runs, lanes = _percentiles(spark, sf_dir, _PERCENTS)
    columns = ["field_name", "run_id", "lane", "pct", "n", "value", (F.col("err") / F.col("n")).alias("rank_error")]
    return runs.select(*columns).unionByName(lanes.withColumn("run_id", F.lit(None).cast("string")).select(*columns))


# -- p5 ---------------------------------------------------------------------------------------------------------------


def _cutoffs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = current_rows(table(spark, sf_dir, "anchor_candidates").select("run_id", "image", "candidate_id", "loaded_at", "lane", "status", "candidate_score"), "candidate_id")
    rows = rows.filter(status().isin("PASS", "WARN") & usable("candidate_score", -2.0, 2.0)).select("run_id", lane().alias("lane"), "candidate_id", "candidate_score")
    rows = materialize(rows, "eligible")
    return rows, cutoff.cutoffs(rows, ["run_id", "lane"], "candidate_score", table(spark, sf_dir, "keep_targets"), "lane")


_SOURCES_SQL = f"WITH e AS (SELECT run_id, {_LANE_SQL} AS lane, candidate_id, candidate_score FROM {_current_sql('anchor_candidates', 'candidate_id')} WHERE {_STATUS_SQL} IN ('PASS', 'WARN') AND candidate_score IS NOT NULL AND NOT isnan(candidate_score) AND candidate_score BETWEEN -2 AND 2), s AS (SELECT e.*, keep_permille, count(*) OVER (PARTITION BY run_id, lane) AS n, count(*) OVER (PARTITION BY run_id, lane ORDER BY candidate_score DESC RANGE UNBOUNDED PRECEDING) AS at_or_above FROM e JOIN keep_targets USING (lane)), c AS (SELECT run_id, lane, any_value(n) AS n, any_value(keep_permille) AS keep_permille, max(candidate_score) FILTER (WHERE 1000 * at_or_above >= keep_permille * n) AS cutoff FROM s GROUP BY run_id, lane)"


@query(_SOURCES_SQL + " SELECT s.candidate_id FROM s JOIN c ON s.run_id IS NOT DISTINCT FROM c.run_id AND s.lane = c.lane WHERE candidate_score >= cutoff")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that their source's cutoff keeps."""
    rows, cuts = _cutoffs(spark, sf_dir)
    return cutoff.kept_rows(rows, cuts, ["run_id", "lane"], "candidate_score").select("candidate_id")


@query(_SOURCES_SQL + " SELECT c.run_id, c.lane, c.n, c.keep_permille, c.cutoff, count(*) AS kept, count(*) FILTER (WHERE candidate_score = cutoff) AS ties FROM s JOIN c ON s.run_id IS NOT DISTINCT FROM c.run_id AND s.lane = c.lane WHERE candidate_score >= cutoff GROUP BY ALL")
def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's cutoff with its size, kept size and ties at the cutoff."""
    return _cutoffs(spark, sf_dir)[1].select("run_id", "lane", "n", "keep_permille", "cutoff", "kept", "ties")


# -- p6 ---------------------------------------------------------------------------------------------------------------


def _top_images(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    rows = current_rows(table(spark, sf_dir, "anchor_candidates").select("run_id", "image", "candidate_id", "loaded_at", "lane", "candidate_score"), "candidate_id")
    rows = rows.filter(usable("candidate_score", -2.0, 2.0)).select("run_id", lane().alias("lane"), "image", "candidate_id", "candidate_score")
    path = topn.cluster_by_group(rows, ["run_id", "lane"], "candidate_score", "image", "candidate_id")
    return topn.top_n(spark, path, n)


_TOP_SQL = f"SELECT * FROM (SELECT candidate_id, candidate_score, image, run_id, {_LANE_SQL} AS lane_, row_number() OVER (PARTITION BY run_id, {_LANE_SQL} ORDER BY candidate_score DESC, image NULLS LAST, candidate_id) AS top_rank FROM {_current_sql('anchor_candidates', 'candidate_id')} WHERE candidate_score IS NOT NULL AND NOT isnan(candidate_score) AND candidate_score BETWEEN -2 AND 2) WHERE top_rank <= 5"


@query(f"SELECT candidate_id FROM ({_TOP_SQL})")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of every run and lane."""
    return _top_images(spark, sf_dir).select(F.col("id").alias("candidate_id"))


@query(f"SELECT candidate_id, image, candidate_score, top_rank FROM ({_TOP_SQL})")
def p6_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with image, score and rank."""
    return _top_images(spark, sf_dir).select(F.col("id").alias("candidate_id"), F.col("tie").alias("image"), F.col("score").alias("candidate_score"), F.col("rank").cast("long").alias("top_rank"))


# -- p7 ---------------------------------------------------------------------------------------------------------------


@query()
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by byte_bpe_50k."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


# -- p8 ---------------------------------------------------------------------------------------------------------------


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = bpe.count_tokens(table(spark, sf_dir, "documents"), keep=("doc_id", "source"), name="size")
    return packing.pack(sizes.withColumnRenamed("doc_id", "id"), 1024)


@query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be cut: those with a second piece."""
    return _packed(spark, sf_dir).filter("piece = 1").select(F.col("id").alias("doc_id"))


@query()
def p8_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with container, start and tokens."""
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


@query()
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of containers, tokens and the share of the containers' room that is used."""
    boxes = _packed(spark, sf_dir).filter("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("tokens").alias("tokens"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.try_divide(F.sum("tokens"), 1024 * F.count("*")).alias("fill"))


# -- p9 ---------------------------------------------------------------------------------------------------------------

#: Spellings of languages (fixed values). Others stand for themselves, up to the first hyphen or underscore.
_LANGUAGES = {"eng": "en", "ger": "de", "deu": "de", "spa": "es", "chi": "zh", "zho": "zh"}


def _subjects(spark: SparkSession, sf_dir: str, examples: DataFrame | None = None):
    spelled = F.create_map(*[F.lit(x) for pair in _LANGUAGES.items() for x in pair])
    tag = F.nullif(F.regexp_extract(F.lower(strip("lang")), "^[^-_]*", 0), F.lit(""))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.try_element_at(spelled, tag), tag).alias("lang"), "text")
    areas = [r.area for r in table(spark, sf_dir, "subject_areas").orderBy("area").collect()]  # a fixed, small table
    labels = table(spark, sf_dir, "subject_examples") if examples is None else examples
    return subjects.fit_subjects(documents, areas, labels.withColumnRenamed("doc_id", "id"))


@query()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's areas."""
    model, encoded = _subjects(spark, sf_dir)
    return subjects.assign_subjects(encoded, model).select(F.col("id").alias("doc_id"), "area")


@query()
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each area's documents and its share of all documents."""
    model, encoded = _subjects(spark, sf_dir)
    everything = table(spark, sf_dir, "documents").count()
    return subjects.assign_subjects(encoded, model).groupBy("area").agg(F.count("*").alias("documents")).withColumn("share", F.col("documents") / F.lit(everything))


@query()
def p9_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics with their inspected top terms and the area these gave them."""
    model, _ = _subjects(spark, sf_dir)
    rows = [(k, model.area_of[k], model.top_terms(k, 20)) for k in range(model.topics.shape[1])]
    return spark.createDataFrame(rows, "topic int, area string, top_terms array<string>")


@query()
def p9_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the labels of one half of the labelled documents come out where the model is given those of the other half.

    One row per area: its labels in the hidden half, how many of them are assigned, and how many documents of that half
    are assigned the area.
    """
    examples = table(spark, sf_dir, "subject_examples")
    hidden = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)) == 1
    model, encoded = _subjects(spark, sf_dir, examples.filter(~hidden))
    labels = examples.filter(hidden).distinct()
    assigned = subjects.assign_subjects(encoded, model).select(F.col("id").alias("doc_id"), "area", F.lit(1).alias("assigned")).join(labels.select("doc_id").distinct(), "doc_id")
    both = labels.withColumn("labelled", F.lit(1)).join(assigned, ["doc_id", "area"], "full")
    return both.groupBy("area").agg(F.count("labelled").alias("labels"), F.count_if(F.col("labelled").isNotNull() & F.col("assigned").isNotNull()).alias("found"), F.count("assigned").alias("assigned"))
