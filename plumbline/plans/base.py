"""What the catalogue's queries share: cleaned tables in Spark and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.tables import current_rows, lane, status, table

_TRIM = "chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"


def lane_sql(c: str = "lane") -> str:
    return f"coalesce(nullif(translate(lower(trim({c}, {_TRIM})), ' -', '__'), ''), 'unknown')"


def status_sql(c: str = "status") -> str:
    return f"upper(trim({c}, {_TRIM}))"


def strip_sql(c: str) -> str:
    return f"trim({c}, {_TRIM})"


def usable_sql(c: str, low: float, high: float) -> str:
    return f"({c} IS NOT NULL AND NOT isnan({c}) AND {c} BETWEEN {low} AND {high})"


def current_sql(name: str, row_id: str) -> str:
    return f"(SELECT * EXCLUDE rn_ FROM (SELECT *, row_number() OVER (PARTITION BY run_id, image ORDER BY loaded_at DESC NULLS LAST, {row_id} DESC) AS rn_ FROM {name}) WHERE rn_ = 1)"


def items(spark: SparkSession, d: str) -> DataFrame:
    """Current report items with clean status."""
    return current_rows(table(spark, d, "report_items"), "item_id").withColumn("status", status())


ITEMS = f"(SELECT * REPLACE ({status_sql()} AS status) FROM {current_sql('report_items', 'item_id')})"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Current anchor candidates with clean lane and status, and score: the usable candidate_score or null."""
    rows = current_rows(table(spark, d, "anchor_candidates"), "candidate_id")
    fine = ~F.isnan("candidate_score") & F.col("candidate_score").between(-2.0, 2.0)
    return rows.withColumn("lane", lane()).withColumn("status", status()).withColumn("score", F.when(fine, F.col("candidate_score")))


CANDIDATES = f"(SELECT * REPLACE ({lane_sql()} AS lane, {status_sql()} AS status), CASE WHEN {usable_sql('candidate_score', -2, 2)} THEN candidate_score END AS score FROM {current_sql('anchor_candidates', 'candidate_id')})"


def routes(spark: SparkSession, d: str) -> DataFrame:
    """Current view routes with clean lane, and conf: the usable confidence or null."""
    rows = current_rows(table(spark, d, "view_routes"), "route_id")
    fine = ~F.isnan("confidence") & F.col("confidence").between(0.0, 1.0)
    return rows.withColumn("lane", lane()).withColumn("conf", F.when(fine, F.col("confidence")))


ROUTES = f"(SELECT * REPLACE ({lane_sql()} AS lane), CASE WHEN {usable_sql('confidence', 0, 1)} THEN confidence END AS conf FROM {current_sql('view_routes', 'route_id')})"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The last manifest entry of each run and image, with expected (clean lane) and a weight of 1, 1.5 or 2."""
    from plumbline.operators.joins import last_wins

    rows = last_wins(table(spark, d, "input_manifest"), ["run_id", "image"], "entry_id")
    return rows.withColumn("expected", lane("intended_view")).withColumn("weight", 1.0 + 0.5 * (F.col("entry_id") % 3))


MANIFEST = f"(SELECT *, {lane_sql('intended_view')} AS expected, 1.0::DOUBLE + 0.5::DOUBLE * (entry_id % 3) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY run_id, image ORDER BY entry_id DESC) AS rn_ FROM input_manifest) WHERE rn_ = 1)"


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Manifest entries with the routed lane of their image: expected, predicted, weight."""
    predicted = routes(spark, d).select("run_id", "image", F.col("lane").alias("predicted"), "lane_detail", "route_source")
    return manifest(spark, d).select("run_id", "image", "entry_id", "anchor_source", "expected", "weight").join(predicted, ["run_id", "image"], "left")


DECISIONS = f"(SELECT m.run_id, m.image, m.entry_id, m.anchor_source, m.expected, m.weight, r.lane AS predicted, r.lane_detail, r.route_source FROM {MANIFEST} m LEFT JOIN {ROUTES} r ON m.run_id = r.run_id AND m.image = r.image)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, as sums depend on the order of their terms in the last digits."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])
