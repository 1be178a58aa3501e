from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as sc
from plumbline.functions import vectors as vec


def one(spark, column, **values):
    """The value of a column over one row of the given doubles."""
    schema = ", ".join(f"{k} double" for k in values) or "x double"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column.alias("out")).first().out


@pytest.mark.parametrize(("x", "want"), [(-1.0, 0.0), (0.5, 0.5), (2.0, 1.0), (None, None)])
def test_clamp_keeps_null(spark, x, want):
    assert one(spark, sc.clamp("x", 0, 1), x=x) == want


def test_linear01_of_an_empty_range_is_zero(spark):
    assert one(spark, sc.linear01("x", 1, 1), x=5.0) == 0.0
    assert one(spark, sc.linear01("x", 0, 4), x=1.0) == 0.25
    assert one(spark, sc.linear01("x", 0, 4), x=None) is None


@pytest.mark.parametrize(("x", "want"), [(0.5, 1.0), (-0.5, 0.5), (-2.0, 0.0), (1.25, 0.75), (None, None)])
def test_soft_range(spark, x, want):
    assert one(spark, sc.soft_range("x", 0, 1, 1.0), x=x) == want


def test_deviation_score_has_a_floor(spark):
    assert [one(spark, sc.deviation_score(F.col("x"), 10, 20), x=x) for x in (5.0, 15.0, 25.0, None, float("nan"))] == [1.0, pytest.approx(0.6), 0.2, None, None]


def test_both_angle_rules(spark):
    assert one(spark, sc.angle_delta(F.col("x"), 350.0), x=10.0) == 20.0
    assert one(spark, sc.angle_delta_wrapped("x", 350.0), x=10.0) == 20.0
    assert one(spark, sc.angle_delta(F.col("x"), 0.0), x=float("inf")) is None


def test_row_weighted_mean_renormalises(spark):
    mean = sc.row_weighted_mean([("a", 0.5), ("b", 0.3), ("c", 0.2)])
    assert one(spark, mean, a=1.0, b=None, c=0.0) == pytest.approx(0.5 / 0.7)
    assert one(spark, mean, a=None, b=None, c=None) is None


def test_row_weighted_mean_skips_non_positive_weights(spark):
    assert one(spark, sc.row_weighted_mean([("a", 1.0), ("b", -1.0)], positive_only=True), a=2.0, b=9.0) == 2.0


def test_geometric_mean_floors(spark):
    assert one(spark, sc.row_geometric_mean([("a", 1.0), ("b", 1.0)]), a=0.0, b=1.0) == pytest.approx(math.sqrt(1e-4))


def test_status_for_missing_and_nan(spark):
    assert [one(spark, sc.status_for(F.col("x"), 0.7, 0.5), x=x) for x in (0.7, 0.6, 0.4, None, float("nan"))] == ["PASS", "WARN", "FAIL", "FAIL", "FAIL"]


def test_box_iou(spark):
    cols = [F.lit(float(v)) for v in (0, 0, 2, 2)]
    assert one(spark, sc.box_iou(cols, [F.lit(float(v)) for v in (1, 1, 3, 3)])) == pytest.approx(1 / 7)
    assert one(spark, sc.box_iou(cols, [F.lit(float(v)) for v in (5, 5, 6, 6)])) == 0.0
    empty = [F.lit(0.0)] * 4
    assert one(spark, sc.box_iou(empty, empty)) == 0.0


def test_joint_angle_without_a_limb(spark):
    z = F.lit(0.0)
    assert one(spark, sc.joint_angle(F.lit(1.0), z, z, z, z, F.lit(1.0))) == pytest.approx(90.0)
    assert one(spark, sc.joint_angle(z, z, z, z, z, F.lit(1.0))) is None


def test_path_keys(spark):
    df = spark.createDataFrame([(x,) for x in (".\\In\\A.PNG", "./in/a.png", "/in/a.png/", "  ", None)], "p string")
    assert [tuple(r) for r in df.select(sc.path_key("p"), sc.base_name("p"), sc.stem("p")).collect()] == [("in/a.png", "a.png", "a")] * 3 + [(None, None, None)] * 2


def test_truth_and_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("Yes", "0", "maybe", None, " 1.5 ")], "t string")
    assert [tuple(r) for r in df.select(sc.truth("t", True), sc.number_or("t", -1.0)).collect()] == [(True, -1.0), (False, 0.0), (True, -1.0), (True, -1.0), (True, 1.5)]


def test_a_time_needs_its_zone(spark):
    df = spark.createDataFrame([("2025-01-01T00:00:00Z",), ("2025-01-01T01:00:00+01:00",), ("2025-01-01T00:00:00",), ("junk Z",), (None,)], "t string")
    found = [r[0] for r in df.select(F.unix_seconds(sc.utc_instant("t"))).collect()]
    assert found == [1735689600, 1735689600, None, None, None]


def test_cosine_and_unit_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vec.cosine("a", "b")).collect()] == [0.0, None, None, None]
    assert [r[0] for r in df.select(vec.unit("b")).collect()][0] == [0.0, 1.0]
    errors = [r.x.errors for r in df.select(vec.angular_distance("a", "b").alias("x")).collect()]
    assert errors[1] == ["VECTOR_WITHOUT_LENGTH"] and errors[2] == ["VECTOR_LENGTHS_DIFFER"] and errors[3] == ["VECTOR_MISSING"]


def test_log_ratios_need_components(spark):
    df = spark.createDataFrame([({"a": 2.0, "b": 1.0, "c": 1.0}, {"a": 1.0, "b": 1.0, "c": 4.0}), ({"a": 2.0}, {"a": 1.0, "b": -1.0})], "c map<string,double>, r map<string,double>")
    first, second = [r[0] for r in df.select(vec.log_ratios("c", "r", 3)).collect()]
    assert first["a"] == pytest.approx(math.log(2)) and first["c"] == pytest.approx(-math.log(4)) and second is None


def test_blended_top(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.5, None, 0.3],), ([],), ([0.4],)], "v array<double>")
    got = [r[0] for r in df.select(vec.blended_top("v", 3)).collect()]
    assert got == [pytest.approx(0.6 * (1.7 / 3) + 0.4 * 0.5), 0.0, pytest.approx(0.4)]


def test_softmax_margin(spark):
    got = one(spark, sc.softmax_margin(["a", "b", "c"]), a=1.0, b=3.0, c=2.0)
    assert got.best == 3.0 and got.margin == 1.0 and sum(got.probabilities) == pytest.approx(1.0)
