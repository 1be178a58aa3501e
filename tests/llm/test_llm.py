"""Each operator against a brute-force version, an exact round trip or a defined edge case."""

from __future__ import annotations

import base64
import datetime as dt
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, clusters, cutoff, neighbours, packing, percentiles, queries, subjects, termcounts, topn
from plumbline.llm.signatures import scaled_parts, unit_vectors, usable_signatures
from tests.conftest import rows_of

VECTORS = "id bigint, vec array<double>"


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def frame(spark, vecs, start=1):
    return spark.createDataFrame([(i + start, [float(x) for x in v]) for i, v in enumerate(vecs)], VECTORS)


# -- vectors ----------------------------------------------------------------------------------------------------------


def test_unusable_signatures_drop_out(spark):
    good_a, good_b = [1.0, 0.0, 0.0], [0.0, 2.0]
    rows = [(1, good_a, good_b), (2, None, good_b), (3, [], good_b), (4, [1.0, 0.0], good_b), (5, [0.0] * 3, good_b), (6, [float("nan"), 1.0, 0.0], good_b), (7, [None, 1.0, 0.0], good_b), (8, [float("inf"), 1.0, 0.0], good_b), (None, good_a, good_b)]
    df = spark.createDataFrame(rows, "metric_id bigint, a array<float>, b array<float>").withColumn("vec", F.lit("clashing"))
    got = unit_vectors(df, "metric_id", {"a": 3, "b": 2}).collect()
    assert [r.id for r in got] == [1, None]
    assert np.allclose(got[0].vec, [math.sqrt(0.5), 0, 0, 0, math.sqrt(0.5)])


def test_signatures_as_delivered_scale_to_the_same_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3).astype(np.float32)], [float(x) for x in rng.normal(size=2).astype(np.float32)]) for i in range(50)] + [(60, None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "metric_id bigint, a array<float>, b array<float>").withColumn("vec", F.lit(1))
    parts = {"a": 3, "b": 2}
    want = {r.id: r.vec for r in unit_vectors(df, "metric_id", parts).collect()}
    got = {r.id: r.vec for r in usable_signatures(df, "metric_id", parts).collect()}
    assert got.keys() == want.keys() and len(got) == 50
    unit_rows = scaled_parts((3, 2))(np.array([got[i] for i in range(50)], np.float32))
    assert np.allclose(unit_rows, [want[i] for i in range(50)], atol=1e-14)


def test_a_forest_of_several_groups_of_leaves(spark, monkeypatch):
    """Rows go to each group once, and the floor of the first tree loses no neighbour that the search alone would find."""
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 150)
    rng = np.random.default_rng(8)
    vecs = unit(np.concatenate([rng.normal(size=(900, 5)), rng.normal(size=(1, 5)) + rng.normal(scale=0.01, size=(300, 5))]))
    got = {}
    for r in neighbours.nearest_neighbours(frame(spark, vecs), 6, leaf_rows=50, search_leaves=30).collect():
        got.setdefault(r.id, []).append((r.neighbour, r.similarity))
    want = brute_neighbours(range(1, 1201), vecs, 6)
    assert all(len(v) == 6 for v in got.values()) and len(got) == 1200
    assert len({(a, b) for a, v in got.items() for b, _ in v} & want) / len(want) >= 0.95
    assert all(abs(vecs[a - 1] @ vecs[b - 1] - s) < 1e-12 for a, v in got.items() for b, s in v)


def brute_neighbours(ids, vecs, k):
    near = vecs @ vecs.T
    return {(a, b) for i, a in enumerate(ids) for b in [y for _, y in sorted((-near[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]]}


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = unit(rng.normal(size=(900, 6)))
    got = {(r.id, r.neighbour) for r in neighbours.nearest_neighbours(frame(spark, vecs), 5, leaf_rows=100, search_leaves=18).collect()}
    want = brute_neighbours(range(1, 901), vecs, 5)
    assert len(got) == 4500 and len(got & want) / len(want) >= 0.95
    exact = neighbours.exact_neighbours(frame(spark, vecs), frame(spark, vecs).filter("id % 50 = 0"), 5)
    assert {(r.id, r.neighbour) for r in exact.collect()} == {p for p in want if p[0] % 50 == 0}


def test_neighbours_of_copies_ties_and_few_rows(spark):
    a, b = [1.0, 0.0], [0.6, 0.8]
    df = spark.createDataFrame([(i, a) for i in range(1, 8)] + [(20, b), (21, b)], VECTORS)
    got = {}
    for r in neighbours.nearest_neighbours(df, 3).orderBy("id", F.col("similarity").desc(), "neighbour").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got[1] == [2, 3, 4] and got[7] == [1, 2, 3] and got[20] == [21, 1, 2] and got[21] == [20, 1, 2]
    few = neighbours.nearest_neighbours(df.filter("id IN (1, 20)"), 10)
    assert {(r.id, r.neighbour) for r in few.collect()} == {(1, 20), (20, 1)}
    assert neighbours.nearest_neighbours(df.limit(0), 10).count() == 0
    assert neighbours.nearest_neighbours(df.filter("id = 1"), 10).count() == 0


def test_a_leaf_larger_than_planned_gets_its_own_forest():
    rng = np.random.default_rng(2)
    vecs = unit(rng.normal(size=(2000, 4)))
    ids = np.arange(2000)
    who, found, _ = neighbours.search_leaf(ids, vecs, ids[:50], vecs[:50], 5, np.full(50, -2.0), 100, 12)
    near = vecs[:50] @ vecs.T
    near[np.arange(50), np.arange(50)] = -2
    want = {(i, j) for i in range(50) for j in np.argsort(-near[i])[:5]}
    assert len(want & set(zip(who.tolist(), found.tolist()))) / 250 >= 0.9


def brute_groups(ids, vecs, least):
    label = dict(zip(ids, ids))
    near = vecs @ vecs.T >= least
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(ids):
            low = min(label[ids[j]] for j in np.flatnonzero(near[i]))
            if low < label[a]:
                label[a], changed = low, True
    return label


@pytest.mark.parametrize("dense", [20_000, 30, 4])
def test_clusters_equal_single_linkage(spark, monkeypatch, dense):
    monkeypatch.setattr(clusters, "DENSE", dense)
    rng = np.random.default_rng(5)
    centres = unit(rng.normal(size=(6, 5)))
    blobs = [unit(c + rng.normal(scale=0.004, size=(n, 5))) for c, n in zip(centres, (60, 30, 9, 8, 7, 3))]
    chain = unit(np.array([[1, 0.01 * i, 0, 0, 0] for i in range(40)]))
    vecs = np.concatenate([*blobs, chain, unit(rng.normal(size=(200, 5))), blobs[0][:4]])
    ids = list(range(1, len(vecs) + 1))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vecs)], VECTORS)
    label = brute_groups(ids, vecs, 0.9999)
    sizes = Counter(label.values())
    want = {(c, i) for i, c in label.items() if sizes[c] >= 8}
    assert {(r.cluster_id, r.id) for r in clusters.cluster_members(df, 0.9999, 8).collect()} == want
    assert any(n >= 40 for n in sizes.values())


def brute_links(vecs, least, block=2000):
    """The smallest row of every row's group, by comparing all rows."""
    label = np.arange(len(vecs))
    pairs = np.concatenate([np.argwhere(vecs[i : i + block] @ vecs.T >= least) + [i, 0] for i in range(0, len(vecs), block)])
    while True:
        low = label.copy()
        np.minimum.at(low, pairs[:, 0], label[pairs[:, 1]])
        if (low == label).all():
            return label
        label = low


def test_clusters_lose_no_link_where_adaptive_execution_chooses_the_joins(spark):
    """Ten copies of 33,000 vectors, each turned by its own matrix: as many members in each as in one by itself."""
    rng = np.random.default_rng(17)
    blobs = [c + rng.normal(scale=0.0025, size=(n, 11)) for c, n in zip(unit(rng.normal(size=(220, 11))), rng.integers(5, 24, 220))]
    base = unit(np.concatenate([*blobs, rng.normal(size=(33_000 - sum(map(len, blobs)), 11))]))
    label = brute_links(base, 0.9999)
    sizes = np.bincount(label, minlength=len(base))
    member = sizes[label] >= 8
    turned = np.concatenate([base @ np.linalg.qr(rng.normal(size=(11, 11)))[0] for _ in range(10)])
    offsets = pa.array(np.arange(len(turned) + 1, dtype=np.int32) * 11)
    frame_ = spark.createDataFrame(pa.table({"id": np.arange(len(turned)), "vec": pa.ListArray.from_arrays(offsets, turned.ravel())}))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = {(r.cluster_id, r.id) for r in clusters.cluster_members(frame_, 0.9999, 8).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert member.sum() > 1000
    assert got == {(len(base) * t + label[i], len(base) * t + i) for t in range(10) for i in np.flatnonzero(member)}


def test_a_cell_of_any_size_is_compared_in_blocks(spark, monkeypatch):
    """One dense blob, a second one beyond reach, a chain out of the first, and lone rows, all in one cell."""
    monkeypatch.setattr(clusters, "DENSE", 60)
    rng = np.random.default_rng(23)
    blob = np.array([1.0, 0, 0, 0]) + rng.normal(scale=0.001, size=(400, 4))
    other = np.array([1.0, 0.03, 0, 0]) + rng.normal(scale=0.0005, size=(50, 4))
    chain = np.array([[1.0, 0, 0.012 * i, 0] for i in range(1, 4)])
    vecs = unit(np.concatenate([blob, other, chain, [[1.0, 0, 0, 0.03], [1.0, 0, -0.03, 0.03]]]))
    ids = np.arange(1, len(vecs) + 1)
    rng.shuffle(ids)
    hot = spark.createDataFrame([(7, int(i), [float(x) for x in v]) for i, v in zip(ids, vecs)], "cell bigint, id bigint, vec array<double>")
    links = clusters._links_in_blocks(hot, 4, 0.9999)
    got = {r.id: r.label for r in clusters.propagate_minima(links).collect()}
    want = brute_groups(ids.tolist(), vecs, 0.9999)
    assert {i: got.get(i, i) for i in ids.tolist()} == want and len(set(want.values())) == 4


def test_dense_cells_are_linked_by_balls():
    rng = np.random.default_rng(7)
    vecs = unit(np.concatenate([[1, 0, 0] + rng.normal(scale=0.01, size=(1200, 3)), [0, 1, 0] + rng.normal(scale=0.002, size=(500, 3))]))
    ids = np.arange(1, 1701)
    got = dict(zip(*(a.tolist() for a in clusters.link(ids, vecs, 0.9999))))
    want = brute_groups(ids.tolist(), vecs, 0.9999)
    assert {i: got.get(i, i) for i in ids.tolist()} == want


def test_no_clusters(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert clusters.cluster_members(empty, 0.9999).count() == 0
    assert clusters.cluster_members(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], VECTORS), 0.9999, 2).count() == 0


def test_cluster_description(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5, 15)] + [(20, [math.cos(0.01), math.sin(0.01)])], VECTORS)
    members = clusters.cluster_members(df, 0.9999, 8)
    row = clusters.describe_clusters(members, df, 0.9999).first()
    assert (row.cluster_id, row["size"], row.densest_rows, row.typical_ids) == (5, 11, 10, [5, 6, 7, 8, 9])


# -- terms ------------------------------------------------------------------------------------------------------------


def test_terms_are_trimmed_and_upper_case(spark):
    df = spark.createDataFrame([(["\ta ", "A", None, " ", "b"],), (None,), ([],)], "r array<string>")
    assert [r[0] for r in df.select(termcounts.terms_of("r")).collect()] == [["A", "A", "B"], [], []]


def test_merged_deltas_equal_a_recount(spark):
    rng = random.Random(4)
    day = dt.datetime(2025, 1, 1)
    rows = [(i, rng.choice(["r1", None]), f"i{rng.randrange(25)}", day + dt.timedelta(days=rng.randrange(60)), rng.choice([None, [rng.choice("abcde") for _ in range(rng.randrange(4))]])) for i in range(80)]
    df = spark.createDataFrame(rows, "route_id int, run_id string, image string, loaded_at timestamp, reasons array<string>")
    changes = termcounts.deliveries_as_changes(df, "route_id", "reasons", F.lit(day + dt.timedelta(days=30))).withColumn("origin", F.lit("t"))
    deltas = termcounts.term_deltas(changes, "terms", "sign", ("origin", "batch"))
    store = termcounts.TermCounts(spark, buckets=3)
    for batch in (0, 1):
        store.merge(deltas.filter(F.col("batch") == batch).drop("batch"))
    current = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        current[r[1], r[2]] = r[4] or []
    want = sorted((t.upper(), sum(r.count(t) for r in current.values()), sum(t in r for r in current.values())) for t in "abcde" if any(t in r for r in current.values()))
    got = rows_of(store.counts().select("term", "occurrences", "records"))
    assert got == want
    again = termcounts.TermCounts.restore(spark, store.manifest())
    assert rows_of(termcounts.TermCounts.open(spark, store.save()).counts()) == rows_of(store.counts())
    assert termcounts.buckets_for(10) == 16 and termcounts.buckets_for(100_000_001) == 101
    gone = store.counts().withColumn("occurrences", -F.col("occurrences")).withColumn("records", -F.col("records"))
    assert again.merge(gone).counts().count() == 0
    assert again.merge(gone.limit(0)).counts().count() == 0


def test_only_touched_buckets_are_rewritten(spark):
    store = termcounts.TermCounts(spark, buckets=8)
    schema = termcounts.TermCounts.SCHEMA
    store.merge(spark.createDataFrame([("o", f"t{i}", 1, 1) for i in range(50)], schema))
    before = dict(store.versions)
    store.merge(spark.createDataFrame([("o", "t1", 2, 1)], schema))
    assert sum(before[b] != store.versions[b] for b in before) == 1
    assert store.counts().filter("term = 't1'").first().occurrences == 3


# -- percentiles ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 511, 1023, 1024, 5000, 60_000])
def test_sketch_error_is_bounded(n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2)
    sketch = percentiles.Sketch()
    for part in np.array_split(values, 7):
        sketch.merge(*percentiles.Sketch().add(part).collapse().state()[:2], *percentiles.Sketch().add(part).collapse().state()[2:]).collapse()
    assert sketch.n == n and sketch.err <= 0.02 * n
    held = sum(len(b) << k for k, bs in sketch.buffers.items() for b in bs) + len(sketch.loose)
    assert held == n
    ordered = np.sort(values)
    for p in (0, 10, 50, 90, 100):
        value, low, high = sketch.percentile(p / 100)
        place = (n - 1) * p / 100
        assert low <= ordered[int(np.floor(place))] and ordered[int(np.ceil(place))] <= high
        if sketch.err == 0:
            assert value == pytest.approx(np.percentile(values, p))


def test_percentiles_of_groups_and_of_merged_groups(spark):
    rng = np.random.default_rng(8)
    rows = [("a", "x", float(v)) for v in rng.random(7000)] + [("b", "x", float(v)) for v in rng.random(30)] + [(None, "x", 0.5), (None, "x", 0.7)]
    df = spark.createDataFrame(rows, "run string, lane string, value double")
    runs = percentiles.sketch_values(df, ["run", "lane"], "value")
    per_run = percentiles.refine(df, percentiles.read_percentiles(runs, ["run", "lane"], (50, 90)), ["run", "lane"], "value")
    lanes = percentiles.read_percentiles(percentiles.merge_sketches(runs, ["lane"]), ["lane"], (50, 90))
    exact = percentiles.refine(df, lanes, ["lane"], "value")
    by_run = {k: [r[2] for r in rows if r[0] == k] for k in ("a", "b", None)}
    assert {(r.run, r.pct): round(r.value, 9) for r in per_run.collect()} == {(k, p): round(float(np.percentile(v, p)), 9) for k, v in by_run.items() for p in (50, 90)}
    assert {r.pct: round(r.value, 9) for r in exact.collect()} == {p: round(float(np.percentile([r[2] for r in rows], p)), 9) for p in (50, 90)}
    assert all(abs(r.value - np.percentile([x[2] for x in rows], r.pct)) < 0.02 for r in lanes.collect())
    assert percentiles.sketch_values(df.limit(0), ["run", "lane"], "value").count() == 0


# -- cutoffs ----------------------------------------------------------------------------------------------------------


def brute_cutoff(scores, keep):
    for c in sorted(set(scores), reverse=True):
        if 1000 * sum(s >= c for s in scores) >= min(keep, 1000) * len(scores):
            return c
    return None


@pytest.mark.parametrize("margin", [0.02, -0.3])
def test_cutoffs_equal_brute_force(spark, margin):
    """A negative margin makes brackets that miss, so that the exact way for the rest runs."""
    rng = random.Random(6)
    rows = [(run, lane, i, round(rng.gauss(0, 1), digits)) for run, lane, n, digits in (("r", "front", 3000, 4), ("r", "side", 40, 1), (None, "front", 7, 2), ("s", "other", 5, 2), ("t", "side", 1, 3), ("u", "all", 9, 2), ("u", "none", 9, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "run string, lane string, id int, score double")
    targets = spark.createDataFrame([("front", 300), ("side", 125), ("all", 2000), ("none", 0)], "lane string, keep_permille int")
    cuts = cutoff.cutoffs(df, ["run", "lane"], "score", targets, "lane", margin=margin)
    groups = {}
    for run, lane, _, s in rows:
        groups.setdefault((run, lane), []).append(s)
    keep = dict(rows_of(targets))
    want = {g: brute_cutoff(v, keep[g[1]]) for g, v in groups.items() if g[1] in keep}
    got = {(r.run, r.lane): r for r in cuts.collect()}
    assert {g: r.cutoff for g, r in got.items()} == want
    assert all(r.kept == sum(s >= r.cutoff for s in groups[g]) and r.ties == groups[g].count(r.cutoff) for g, r in got.items())
    assert cutoff.kept_rows(df, cuts, ["run", "lane"], "score").count() == sum(r.kept for r in got.values())


# -- top n ------------------------------------------------------------------------------------------------------------


def test_top_n_equals_sorting(spark):
    rng = random.Random(9)
    rows = [(g, "l", rng.choice([None, f"i{rng.randrange(500):03}"]), i, rng.choice([None, float("nan"), round(rng.random(), 2)])) for g, n in (("hot", 6000), ("b", 40), (None, 9), ("c", 2), ("", 6)) for i in range(n)]
    df = spark.createDataFrame(rows, "run string, lane string, image string, id bigint, score double").withColumn("grp", F.lit(1))
    path = topn.cluster_by_group(df, ["run", "lane"], "score", "image", "id", row_group_bytes=4096)
    assert topn.row_group_statistics(spark, path).count() > 4
    got = {(r.grp, r["rank"]): (r.score, r.tie, r.id) for r in topn.top_n(spark, path, 5).collect()}
    groups = {}
    for run, _, image, i, s in rows:
        if s is not None and s == s:
            groups.setdefault(run, []).append((s, image, i))
    want = sorted(x for v in groups.values() for x in sorted(v, key=lambda r: (-r[0], r[1] is None, r[1] or "", r[2]))[:5])
    assert sorted(got.values(), key=repr) == sorted(want, key=repr) and len({g for g, _ in got}) == len(groups)


def test_top_n_skips_what_the_footers_rule_out(spark, monkeypatch):
    df = spark.createDataFrame([("g", "l", f"i{i}", i, i / 5000) for i in range(5000)], "run string, lane string, image string, id bigint, score double")
    path = topn.cluster_by_group(df, ["run", "lane"], "score", "image", "id", files=4, row_group_bytes=4096)
    statistics = topn.row_group_statistics(spark, path).collect()
    top = max(statistics, key=lambda r: r.high)
    assert sum(r.high >= top.low for r in statistics) < len(statistics) / 2
    assert [r.id for r in topn.top_n(spark, path, 3).orderBy("rank").collect()] == [4999, 4998, 4997]


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "run string, lane string, image string, id bigint, score double")
    assert topn.top_n(spark, topn.cluster_by_group(df, ["run", "lane"], "score", "image", "id"), 3).count() == 0


# -- tokens -----------------------------------------------------------------------------------------------------------

TEXTS = ["", None, "Hello world", "  a\t\n b  ", "don't we'll", "x" * 5000, "日本語の文章。" * 40, "🙂👍🏽 ﷽ ẞß", "<|endoftext|>", "abc\u0000def", "1234567890 " * 50, " ", "é é"]


def test_ids_equal_two_other_encoders(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 0x4E00 + rng.randrange(900)])) for _ in range(rng.randrange(200))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("key", F.lit("clash"))
    got = {r.doc_id: r.ids for r in bpe.encode_documents(df).collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}
    assert [other.decode(got[i]) for i, t in enumerate(texts)] == [t or "" for t in texts]


def test_encoding_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode_documents(df).count() == 0 and bpe.count_tokens(df).count() == 0


# -- packing ----------------------------------------------------------------------------------------------------------


def packed(spark, rows, **more):
    return packing.pack(spark.createDataFrame(rows, "id bigint, source string, size bigint"), 100, **more).collect()


def check_packing(rows, got, capacity=100):
    pieces = {}
    for r in got:
        pieces.setdefault(r.id, []).append(r)
    assert set(pieces) == {i for i, _, _ in rows}
    for i, _, size in rows:
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert sum(r.tokens for r in own) == (size or 0) and [r.piece for r in own] == list(range(len(own)))
        assert len(own) == max(1, -(-(size or 0) // capacity))
    boxes = {}
    for r in got:
        if r.container_id is not None:
            boxes.setdefault(r.container_id, []).append((r.start, r.tokens))
    for held in boxes.values():
        at = 0
        for start, tokens in sorted(held):
            assert start == at
            at += tokens
        assert at <= capacity
    return boxes


def test_items_are_packed_whole_and_tightly(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", " A", "b", None, ""]), rng.choice([0, None, 1, 99, 100, 101, 350, *[rng.randrange(1, 60)] * 12])) for i in range(3000)]
    boxes = check_packing(rows, packed(spark, rows, window_containers=32))
    assert sum(s or 0 for _, _, s in rows) / (100 * len(boxes)) > 0.97
    assert packed(spark, []) == []
    check_packing([(1, "a", 0)], packed(spark, [(1, "a", 0)]))


def test_windows_hold_the_target_proportions(spark):
    rows = [(i, "a" if i % 3 else "b", 10) for i in range(6000)]
    items = spark.createDataFrame(rows, "id bigint, source string, size bigint")
    per = {}
    for r in packing.assign_windows(items, 100, 20).groupBy("window", "source").agg(F.sum("size").alias("t")).collect():
        per.setdefault(r.window, {})[r.source] = r.t
    assert all(abs(w["a"] / sum(w.values()) - 2 / 3) < 0.02 for n, w in per.items() if n < max(per))
    half = packing.assign_windows(items, 100, 20, {"a": 0.5, "b": 0.5}).groupBy("window").pivot("source").agg(F.sum("size")).orderBy("window").collect()
    assert half[0].a == half[0].b and sum((r.a or 0) + (r.b or 0) for r in half) == 60000


def test_best_fit():
    box, start = packing.best_fit(np.array([60, 50, 40, 50]), 100)
    assert box[0] == box[2] and box[1] == box[3] and sorted(start) == [0, 0, 50, 60]


# -- subjects ---------------------------------------------------------------------------------------------------------


def test_sentences_without_headings_and_prefixes():
    text = "## Step 14\n\nThe hem is short. It clashes!\n[10:20:15] ERROR the bus hangs #42\n- swap the cable\n[PLATE 6]\nTicket 99\n裙摆之后再看风衣 < 73%。针织袖子\n👍\n"
    assert [" ".join(s.split()) for s in subjects.sentences(text)] == ["the hem is short.", "it clashes!", "the bus hangs", "swap the cable", "裙摆之后再看风衣 < 。", "针织袖子"] or len(subjects.sentences(text)) == 6
    assert subjects.sentences(None) == subjects.sentences("") == subjects.sentences(" \n ") == []
    assert len(subjects.sentences('{"kind": "note", "body": "One is here. Two is there."}')) == 2
    assert subjects.sentences("{broken text here") == ["{broken text here"]


def test_subjects_of_held_out_documents(spark):
    rng = random.Random(3)
    words = {"law": ["contract", "licence", "court", "consent", "claim", "clause"], "sport": ["runner", "sprint", "balance", "coach", "stride", "relay"], "fashion": ["collar", "seam", "fabric", "sleeve", "hem", "lapel"]}
    docs, truth = [], {}
    for i in range(600):
        areas = rng.sample(sorted(words), rng.choice([1, 1, 1, 2]))
        lines = [f"in this batch the {rng.choice(words[a])} meets the {rng.choice(words[a])} on both sides" for a in areas for _ in range(4)]
        docs.append((i, rng.choice(["en", None]) if i % 7 == 0 else "en", ". ".join(lines) + "."))
        truth[i] = set(areas)
    docs += [(900, "en", None), (901, None, ""), (902, "en", "   ")]
    labels = [(i, a) for i in range(0, 150) for a in truth[i]] + [(160, "law"), (99999, "sport"), (5, "no such area")]
    model, encoded = subjects.fit_subjects(spark.createDataFrame(docs, "id bigint, lang string, text string"), sorted(words), spark.createDataFrame(labels, "id bigint, area string"))
    got = {}
    for r in subjects.assign_subjects(encoded, model).collect():
        got.setdefault(r.id, set()).add(r.area)
    held_out = [i for i in truth if i >= 150]
    assert sum(got.get(i) == truth[i] for i in held_out) / len(held_out) >= 0.97
    assert not {900, 901, 902} & set(got)
    assert {a for a in model.area_of if a} == set(words) and "contract" in model.top_terms(model.layout.topic(sorted(words).index("law"), "en"), 40)
    assert model.layout.languages == ["en"]
    whole = subjects.topic_proportions(encoded, model).groupBy("id").agg(F.sum("proportion").alias("p")).collect()
    assert len(whole) == 600 and all(abs(r.p - 1) < 1e-9 for r in whole)


def test_a_vocabulary_holds_what_has_its_share_in_some_language(spark):
    rows = [("en", ["common"] * 996 + ["rare"] * 4), ("de", ["rare"] * 3 + ["once"]), (None, ["lost"] * 3), ("es", None)]
    split = spark.createDataFrame(rows, "lang string, terms array<string>")
    assert subjects.vocabulary(split, share=0.01) == ["common", "lost", "rare"]
    assert subjects.vocabulary(split.filter("lang = 'en'"), share=0.01) == ["common"]
    assert subjects.vocabulary(split.limit(0)) == []


def test_subjects_without_documents_or_labels(spark):
    empty = spark.createDataFrame([], "id bigint, lang string, text string")
    none = spark.createDataFrame([], "id bigint, area string")
    model, encoded = subjects.fit_subjects(empty, ["law"], none)
    assert subjects.assign_subjects(encoded, model).count() == 0
    some = spark.createDataFrame([(i, "en", "the court is here. the court is there.") for i in range(5)], "id bigint, lang string, text string")
    model, encoded = subjects.fit_subjects(some, ["law"], none)
    assert subjects.assign_subjects(encoded, model).count() == 0


# -- whole queries ----------------------------------------------------------------------------------------------------

SOURCE = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module", params=["empty", "nulls"])
def bare_tables(request, tmp_path_factory):
    """The test tables without rows, and with null in every column but the row ids."""
    if not SOURCE.is_dir():
        pytest.skip("no test tables")
    ids = {"view_routes": "route_id", "anchor_candidates": "candidate_id", "parser_metrics": "metric_id", "documents": "doc_id"}
    folder = tmp_path_factory.mktemp(request.param)
    for path in SOURCE.glob("*.parquet"):
        rows = pq.read_table(path)
        if request.param == "empty":
            rows = rows.slice(0, 0)
        elif path.stem in ids:
            rows = rows.slice(0, 20)
            rows = pa.table([rows.column(c) if c == ids[path.stem] else pa.nulls(20, rows.schema.field(c).type) for c in rows.column_names], schema=rows.schema)
        pq.write_table(rows, folder / path.name)
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_over_bare_tables(spark, bare_tables, name):
    rows = queries.queries()[name](spark, bare_tables).collect()
    if name.endswith("_found"):
        assert rows == []
