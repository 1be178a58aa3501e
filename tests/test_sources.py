from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException

from plumbline.sources import readers, sinks
from tests.conftest import rows_of


def test_images_by_suffix(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.PNG", "a.jpg", "c.txt", "sub/d.webp"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(readers.list_images(spark, str(tmp_path))) == ["a.jpg", "b.PNG"]
    assert names(readers.list_images(spark, str(tmp_path), recursive=True)) == ["a.jpg", "b.PNG", "d.webp"]
    assert readers.list_images(spark, str(tmp_path / "none")).count() == 0


def test_json_documents_strict_and_lenient(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿{"a": [{"b": 5}]}')
    (tmp_path / "b.json").write_text("[1, 2]")
    (tmp_path / "c.json").write_text("broken")
    docs = readers.read_json_documents(spark, str(tmp_path))
    assert sorted(r.v or 0 for r in docs.select(readers.at_path("doc", "a.0.b", "int").alias("v")).collect()) == [0, 0, 5]
    with pytest.raises(PySparkException):
        readers.read_json_documents(spark, str(tmp_path), strict=True).selectExpr("to_json(doc)").collect()


def test_label_bundle(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"schema_version": readers.LABELS_VERSION, "optuna_ready": "yes", "items": {" a.png ": {"expected_status": "pass", "weight": 2}, "b.png": {"status": "FAIL"}}}))
    got = {r.image: (r.expected_status, r.weight, r.optuna_ready) for r in readers.read_label_bundle(spark, str(path)).collect()}
    assert got == {"a.png": ("PASS", 2.0, True), "b.png": ("FAIL", 1.0, True)}
    path.write_text(json.dumps({"schema_version": "other", "items": {"a": {"status": "PASS"}}}))
    with pytest.raises(PySparkException):
        readers.read_label_bundle(spark, str(path)).collect()


@pytest.mark.parametrize("root", [{"items": [{"image": "in/A.png", "seed": 5}]}, {"images": {"in/A.png": {"seed": "5"}}}, {"version": "1", "in/A.png": {"seed": 5}}, {"generator": {"seed": 1}, "created_at": {"seed": 2}, "in/A.png": {"seed": 5}}])
def test_manifest_shapes(spark, tmp_path, root):
    (tmp_path / "m.json").write_text(json.dumps(root))
    row = readers.read_manifest_entries(spark, str(tmp_path / "m.json")).first()
    assert (row.path_key, row.name_key, row.seed, row.seed_number) == ("in/a.png", "a.png", "5", 5)


def test_search_by_aliases(spark):
    """Keys as spelled, the first alias that an object has, a null value ends its object only, depth bounded."""
    texts = ['{"x": {"yaw": 3, "z": 1}}', '{"l": [{"roll": 1}, {"yaw": [1]}]}', "bad", None, '{"x": {"Yaw": 3}}', '{"head_yaw": 1, "yaw": 2}', '{"x": {"yaw": null, "y": {"yaw": 5}}, "z": {"yaw": 6}}', "[]", "7", '{"a":{"a":{"a":{"yaw":1}}}}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(readers.search_aliases("t", ["yaw", "head_yaw"], depth=2)).collect()] == ["3", "[1]", None, None, None, "2", "6", None, None, None]


def test_label_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", "PASS", ["x", "y"]), ("a", "WARN", [])], "image string, expected_status string, must_have_reasons array<string>")
    sinks.write_label_csv(df, str(tmp_path / "csv"), ["image", "expected_status", "must_have_reasons"])
    lines = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "image,expected_status,must_have_reasons" and lines[1].startswith("a,") and lines[2] == "b,PASS,x | y"


def test_csv_labels_of_any_separator(spark, tmp_path):
    (tmp_path / "l.csv").write_text(",".join(readers.LABEL_COLUMNS) + '\na.png,PASS,,,,,"A;B，C | D",,n\n')
    row = readers.read_label_csv(spark, str(tmp_path / "l.csv")).first()
    assert row.must_have_reasons == ["A", "B", "C", "D"] and row.weight == 1.0


def test_upserted_table_keeps_one_row_per_key(spark, tmp_path):
    schema, path = "k string, v int, x string", str(tmp_path / "bank")
    sinks.upsert_table(spark, path, spark.createDataFrame([("a", 1, "o"), ("a", 2, "p")], schema), ["k"], "v")
    sinks.upsert_table(spark, path, spark.createDataFrame([("a", 3, "q"), ("b", 1, "r")], schema), ["k"], "v")
    assert rows_of(sinks.read_latest(spark, path)) == [("a", 3, "q"), ("b", 1, "r")]


def test_documents_are_replaced_whole(spark, tmp_path):
    path = tmp_path / "doc.json"
    sinks.write_document(spark, str(path), "one")
    sinks.write_document(spark, str(path), "zwei ü")
    assert path.read_text() == "zwei ü" and not list(tmp_path.glob("*.tmp"))


def test_partitioned_write_spreads_a_hot_value(spark, tmp_path):
    df = spark.createDataFrame([("PASS", i) for i in range(40)] + [("FAIL", 1)], "status string, id int")
    sinks.write_partitioned(df, str(tmp_path / "p"), ["status"], files_per_value=4)
    assert len(list((tmp_path / "p" / "status=PASS").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "p")).count() == 41


def test_sidecar_by_priority(spark):
    images = spark.createDataFrame([("in/a.png",), ("in/b.png",)], "path string")
    files = spark.createDataFrame([("x/a.low.json",), ("x/a.high.json",)], "path string")
    got = {r.path: r.sidecar for r in readers.sidecars(images, files, [".high.json", ".low.json"]).collect()}
    assert got == {"in/a.png": "x/a.high.json", "in/b.png": None}
