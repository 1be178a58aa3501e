from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.tables import current_rows, lane, status, usable
from tests.conftest import rows_of

DAY = dt.datetime(2025, 1, 1)


def test_current_row_is_the_last_loaded_then_the_largest_id(spark):
    later = DAY + dt.timedelta(days=1)
    rows = [("r", "a", 1, DAY), ("r", "a", 2, later), ("r", "a", 3, later), ("r", "b", 9, None), ("r", "b", 8, DAY), (None, None, 5, DAY), (None, None, 6, DAY), ("r", None, 7, None)]
    df = spark.createDataFrame(rows, "run_id string, image string, id int, loaded_at timestamp")
    assert {r.id for r in current_rows(df, "id").collect()} == {3, 8, 6, 7}
    assert current_rows(df.limit(0), "id").collect() == []


def test_lane_and_status_spellings(spark):
    df = spark.createDataFrame([(x,) for x in (" Front", "side-90", "Three Quarter", "\tback_180  ", "", "  ", None)], "lane string")
    assert [r[0] for r in df.select(lane()).collect()] == ["front", "side_90", "three_quarter", "back_180", "unknown", "unknown", "unknown"]
    assert [r[0] for r in spark.createDataFrame([(" Warn",), ("pass\t",), (None,)], "status string").select(status()).collect()] == ["WARN", "PASS", None]


def test_usable_is_never_null(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.1, -0.1, float("nan"), float("inf"), float("-inf"), None)], "v double")
    assert [r[0] for r in df.select(usable("v", 0.0, 1.0)).collect()] == [True, True] + [False] * 6


def test_current_rows_keep_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("r", "a", 1, DAY, "x")], "run_id string, image string, id int, loaded_at timestamp, rn string")
    assert rows_of(current_rows(df, "id").select("rn", F.col("id"))) == [("x", 1)]
