"""The tables and what their columns mean: current rows, lanes, statuses, usable values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Every character that Python and SQL dialects count as white space, tabs and Unicode blanks included.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

ROW_IDS = {"view_routes": "route_id", "anchor_candidates": "candidate_id", "parser_metrics": "metric_id", "report_items": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(c: Column | str) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def lane(c: Column | str = "lane") -> Column:
    """Trimmed, lower case, each inner blank or hyphen an underscore; null and blank read as unknown."""
    text = F.translate(F.lower(strip(c)), " -", "__")
    return F.when(text.isNull() | (text == ""), F.lit("unknown")).otherwise(text)


def status(c: Column | str = "status") -> Column:
    return F.upper(strip(c))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def usable(c: Column | str, low: float, high: float) -> Column:
    """Not null, not NaN and within [low, high]; never null itself."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.isnan(col) & (col >= low) & (col <= high), F.lit(False))


def current_rows(df: DataFrame, row_id: str, keys: tuple[str, ...] = ("run_id", "image"), loaded: str = "loaded_at") -> DataFrame:
    """Of the rows with equal keys (null equals null) the one loaded last, then of the largest row id.

    A null load time is older than any other. The rank filter row_number = 1 lets Spark keep one row per key before
    the shuffle, so repeated deliveries of one key never gather in one task.
    """
    rank = "__rank_of_delivery"
    order = Window.partitionBy(*keys).orderBy(F.col(loaded).desc_nulls_last(), F.col(row_id).desc_nulls_last())
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank)
