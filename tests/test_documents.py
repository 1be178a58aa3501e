from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions import measures as ms
from plumbline.operators import documents, records, running
from plumbline.operators.running import distributed_rank, exact_percentiles, running_totals
from tests.conftest import rows_of


def test_anchor_pools_need_a_usable_anchor(spark):
    registry = spark.createDataFrame([("face", "front", "a"), ("body", "back", "b")], "role string, view string, path string")
    features = spark.createDataFrame([("a", True, 1.0), ("b", False, 2.0)], "path string, ok boolean, f double")
    assert [r.path for r in documents.anchor_pools(registry, features, ["face"]).collect()] == ["a"]
    with pytest.raises(PySparkException):
        documents.anchor_pools(registry, features, ["face", "body"]).collect()


def test_first_path_and_settings(spark, tmp_path):
    (tmp_path / "b").write_text("x")
    assert documents.first_path(spark, [str(tmp_path / "a"), str(tmp_path / "b")]) == str(tmp_path / "b")
    assert documents.first_path(spark, [str(tmp_path / "a")]) is None
    assert rows_of(documents.settings_frame(spark, {"b": 1, "a": None})) == [("a", None, "NoneType"), ("b", "1", "int")]


def test_master_reference_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert documents.master_reference(df, ["a", "b"]) == {"a": 2.0, "b": None}


def test_masks(spark):
    df = spark.createDataFrame([([[1, 0, 1], [0, 1, 1]],), ([[0, 0]],), ([],)], "m array<array<int>>")
    got = df.select(ms.mask_ratio("m"), ms.mirror_overlap("m"), ms.row_widths("m")).collect()
    assert tuple(got[0]) == (pytest.approx(4 / 6), pytest.approx(3 / 5), [3, 2]) and tuple(got[1]) == (0.0, None, [None]) and tuple(got[2]) == (None, None, [])


@pytest.fixture(params=[500_000, 200])
def task_rows(request, monkeypatch):
    """Rows of a task: the whole table in one, and a hot group in parts."""
    monkeypatch.setattr(running, "TASK_ROWS", request.param)


def test_running_totals_of_a_hot_group(spark, task_rows):
    rows = [("hot", i % 97, i) for i in range(3000)] + [(None, 1, 5000), (None, 2, 5001), ("b", 1, 6000)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    got = {r.id: (r.total, r.whole) for r in running_totals(df, ["k"], [F.col("v"), F.col("id")], {"total": F.col("v")}, {"whole": F.lit(1)}).collect()}
    want, sums = {}, {}
    for k, v, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        sums[k] = sums.get(k, 0) + v
        want[i] = (sums[k], sum(r[0] == k for r in rows))
    assert got == want
    ranks = distributed_rank(df, ["k"], [F.col("v"), F.col("id")])
    assert ranks.filter("k = 'hot'").agg(F.count_distinct("rank"), F.max("rank")).first()[:] == (3000, 3000)
    assert running_totals(df.limit(0), ["k"], [F.col("v")], {"t": F.col("v")}).count() == 0


def test_exact_percentiles(spark, task_rows):
    import numpy as np

    rng = np.random.default_rng(0)
    values = {"a": rng.random(500).round(2), "b": np.array([1.0, 1.0, 2.0]), None: np.array([5.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("c", None)], "k string, v double")
    got = {(r.k, r.pct): r.value for r in exact_percentiles(df, ["k"], "v", [0, 33, 50, 100]).collect()}
    assert got == {(k, float(p)): pytest.approx(np.percentile(v, p)) for k, v in values.items() for p in (0, 33, 50, 100)}


def test_the_engine_measures_what_is_not_done(spark):
    trials = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "spec string, x double")
    done = spark.createDataFrame([("a", 9.0)], "spec string, residual double")
    out = records.run_repeatability(trials, done, "spec", lambda t: t.withColumn("residual", F.col("x") * 2), lambda t: t, lambda t: t.select("spec", "residual"), lambda i: i.agg(F.max("residual").alias("top")))
    assert rows_of(out["items"]) == [("a", 9.0), ("b", 4.0)] and out["cohort"].first().top == 9.0


def test_guards_and_protocols():
    with pytest.raises(PermissionError, match="second"):
        records.require([(True, "first"), (False, "second")])
    good = {"transform_id": "x", "domain": "d", "family": "f", "repeat_count": 1}
    assert records.protocol_issues([good], ["f"]) == []
    assert records.protocol_issues([good, good, {"transform_id": " ", "family": "z", "repeat_count": 0}], ["f"]) == ["TRANSFORM_REPEATED:x", "TRANSFORM_WITHOUT_ID:2", "FAMILY_UNKNOWN:", "REPEAT_COUNT_INVALID:"]


def test_registry_snapshot(spark):
    import hashlib

    digest = hashlib.sha256(b"x").hexdigest()
    registry = spark.createDataFrame([("a", digest), ("b", None), ("c", "no"), ("d", digest)], "path string, expected_sha256 string")
    files = spark.createDataFrame([(p, bytearray(b"x")) for p in "abc"], "path string, content binary")
    assert {r.path: r.state for r in records.registry_snapshot(registry, files).collect()} == {"a": "MATCH", "b": "UNPINNED", "c": "MISMATCH", "d": "MISSING"}


def test_header_update_keeps_what_is_not_given(spark):
    header = spark.createDataFrame([("v1", "old")], "schema_version string, freeze_tag string")
    assert rows_of(records.updated_header(header, freeze_tag="new", schema_version=None)) == [("v1", "new")]
