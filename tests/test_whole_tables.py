"""Queries over whole tables, against brute force on small ones, and the segment trees alone."""

from __future__ import annotations

import random

import pytest
from tests.conftest import rows_of

import __spark_entry__
from plumbline.llm import bpe
from plumbline.operators import graph

QUERIES = __spark_entry__.queries()


def _tables(spark, path, lines, suppliers, parts):
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in suppliers], "s_suppkey long").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(i,) for i in parts], "p_partkey long").write.parquet(f"{path}/part.parquet")
    edges = {(f"c{s}", f"c{p}") for _, s, p in lines} | {("c58", "c41"), ("c41", "c58"), ("x1", "c3"), ("c3", "x2")}
    return {f"c{i}" for i in (*suppliers, *parts)}, edges


def _distances(edges):
    """Of every node its ancestors with the least number of edges, by breadth-first search."""
    parents, found = {}, {}
    for s, t in edges:
        parents.setdefault(t, set()).add(s)
    for node in parents:
        front, distance = {node}, 0
        while front:
            distance += 1
            front = {a for x in front for a in parents.get(x, ()) if (node, a) not in found}
            found |= {(node, a): distance for a in front}
    return found


def test_graphs_over_the_whole_table(spark, tmp_path):
    rng = random.Random(7)
    lines = [(rng.randrange(1, 97), rng.randrange(150), rng.randrange(100, 400)) for _ in range(220)]  # no order key is divisible by 97
    nodes, edges = _tables(spark, tmp_path, lines, range(149), range(100, 400))
    edges_with_nodes = {(s, t) for s, t in edges if s in nodes and t in nodes}
    within = _distances(edges_with_nodes)
    cyclic = {a for a, b in within if a == b}
    run = lambda name: rows_of(QUERIES[name](spark, str(tmp_path)))

    assert run("q_whole_ancestors") == sorted(((n, a, k) for (n, a), k in _distances(edges).items()), key=repr)
    assert max(_distances(edges).values()) > 2
    assert run("q_whole_cycle_check") == sorted(((n,) for n in nodes if n in cyclic or any((n, c) in within for c in cyclic)), key=repr)
    issues = {("SOURCE_MISSING", s) if s not in nodes else ("TARGET_MISSING", t) for s, t in edges if s not in nodes or t not in nodes}
    assert run("q_whole_dangling_edges") == sorted(issues, key=repr)


def _shuffled_rows(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_ancestors_shuffle_fewer_rows_than_there_are_pairs(spark):
    rng = random.Random(11)
    edges = [(s, t) for t in range(1000) for s in rng.sample(range(400), 12)]
    before = _shuffled_rows(spark)
    found = rows_of(graph.ancestors(spark.createDataFrame(edges, "source_id long, target_id long")))
    assert found == sorted(((n, a, k) for (n, a), k in _distances(set(edges)).items()), key=repr)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < sum(n for stage, n in _shuffled_rows(spark).items() if stage not in before) < len(found)


def _shuffled_bytes(spark):
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_ancestors_shuffle_less_than_two_bytes_for_each_pair(spark):
    rng = random.Random(5)
    edges = [(f"node-{s}", f"node-{t}") for t in range(3000) for s in rng.sample(range(400), 12)]
    before = _shuffled_bytes(spark)
    found = graph.ancestors(spark.createDataFrame([*edges, *edges[:99]], "source_id string, target_id string")).collect()
    want = _distances(set(edges))
    assert len(found) == len(want) and {(r.node_id, r.ancestor_id): r.distance for r in found} == want
    assert 0 < sum(n for stage, n in _shuffled_bytes(spark).items() if stage not in before) < 2 * len(want)


def test_ancestors_of_no_edges(spark):
    assert graph.ancestors(spark.createDataFrame([], "source_id string, target_id string")).collect() == []


def test_ancestors_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_NODES", 3)
    run = lambda edges, **rounds: rows_of(graph.ancestors(spark.createDataFrame(edges, "source_id string, target_id string"), **rounds))
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(20)}") for _ in range(30)]
    assert run(edges) == sorted(((n, a, k) for (n, a), k in _distances(set(edges)).items()), key=repr)
    # null is an end like any other, but no path goes on through it
    assert run([("a", "b"), (None, "a"), ("b", None), (None, "x")]) == sorted([("b", "a", 1), ("a", None, 1), (None, "b", 1), (None, "a", 2), ("b", None, 2), (None, None, 3), ("x", None, 1)], key=repr)
    path = [(f"n{i}", f"n{i + 1}") for i in range(4)]
    assert len(run(path, most_rounds=4)) == 10
    with pytest.raises(RuntimeError, match="longer than 3 edges"):
        run(path, most_rounds=3)


def test_every_brand_has_a_reference_and_every_run_a_comparison(spark, tmp_path):
    parts = [(k, f"b{k % 7}", 10.0 * k) for k in range(20, 60)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert rows_of(QUERIES["q_whole_against_references"](spark, str(tmp_path)).select("p_partkey", "reference")) == sorted(((k, min(j for j, b, _ in parts if b == brand)) for k, brand, _ in parts), key=repr)

    spark.createDataFrame([("r1", "A"), ("r2", "A"), ("r30", "B"), ("r4", "B")], "run_id string, layer string").write.parquet(f"{tmp_path}/review_runs.parquet")
    spark.createDataFrame([("r1", ("A",)), ("r2", ("B",)), ("r30", ("B",))], "run_id string, collection_meta struct<layer_key: string>").write.parquet(f"{tmp_path}/report_items.parquet")
    assert rows_of(QUERIES["q_whole_comparison_state"](spark, str(tmp_path))) == [("r1", True), ("r2", False), ("r30", True), ("r4", None)]


def test_shapes_are_fitted_over_all_coordinates(spark, tmp_path):
    rng = random.Random(3)
    first = [rng.gauss(0, 1) for _ in range(64)]
    other = first[:12] + [rng.gauss(0, 1) for _ in range(52)]  # the first six points are the same
    spark.createDataFrame([(1, 0, first), (2, 0, first), (3, 0, other)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    residual = {r.vec_id: r.residual for r in QUERIES["q_procrustes"](spark, str(tmp_path)).collect()}
    assert residual[1] < 1e-6 and residual[2] < 1e-6 and residual[3] > 1e-2


def test_masks_are_made_of_all_coordinates(spark, tmp_path):
    spark.createDataFrame([(1, [-1.0] * 32 + [1.0] * 32), (2, [-1.0] * 63 + [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows_of(QUERIES["q_whole_masks"](spark, str(tmp_path)).select("vec_id", "ratio", "mirror")) == [(1, 0.5, 1.0), (2, 0.015625, 0.0)]


def test_the_whole_manifest_passes_the_readers(spark, tmp_path):
    rows = [(1, "r1", "A.png", "p", "5", None, "", " Front"), (999, "r1", "A.png", None, "s-7", "lost", "set", None), (1000, "r2", "b.png", "q", "", None, None, "  "), (2500, "r3", "c.png", "p", None, None, "x", "front")]
    spark.createDataFrame(rows, "entry_id long, run_id string, image string, prompt_id string, seed string, seed_unavailable_reason string, anchor_source string, intended_view string").write.parquet(f"{tmp_path}/input_manifest.parquet")
    number = {"5": 5}
    assert rows_of(QUERIES["q_whole_manifest_file"](spark, str(tmp_path))) == sorted(((str(i), f"{r}/{im.lower()}", p, s, number.get(s), why, a, v) for i, r, im, p, s, why, a, v in rows), key=repr)


def test_trees_alone_give_every_vocabulary_entry_its_id():
    ranks, by_size = bpe.load_ranks(), {}
    for word, number in ranks.whole.items():
        token = word.encode("utf-8", "surrogateescape")
        by_size.setdefault(max(2, 1 << (len(token) - 1).bit_length()), []).append((token, number))
    for size, group in by_size.items():
        step = max(1, bpe.STACK_CELLS // size)
        for start in range(0, len(group), step):
            part = group[start : start + step]
            assert ranks.merge_stack([token for token, _ in part], size) == [[number] for _, number in part]
