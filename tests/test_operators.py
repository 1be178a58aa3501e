from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import aggregates as ag
from plumbline.operators import cohesion, graph, joins, ranking, repeatability, replay, sets
from tests.conftest import rows_of


def cells(spark, rows):
    return spark.createDataFrame(rows, "expected string, predicted string, weight double")


def test_precision_is_one_without_predictions(spark):
    got = {r["class"]: r for r in ag.class_metrics(cells(spark, [("PASS", "WARN", 2.0), ("WARN", "WARN", 1.0)])).collect()}
    assert (got["PASS"].precision, got["PASS"].recall, got["PASS"].f1) == (1.0, 0.0, 0.0)
    assert got["WARN"].precision == pytest.approx(1 / 3) and got["WARN"].recall == 1.0


def test_overall_metrics_average_active_classes_only(spark):
    row = ag.overall_metrics(cells(spark, [("PASS", "PASS", 1.0), ("WARN", "PASS", 1.0)]), "PASS").first()
    assert row.accuracy == 0.5 and row.false_rate == 0.5 and row.macro_f1 == pytest.approx((2 / 3) / 2)
    assert row.safety == pytest.approx(0.45 * row.macro_f1 + 0.35 * 0.5 + 0.2 * 0.5)
    assert ag.overall_metrics(cells(spark, []), "PASS").count() == 0


def test_optional_accuracy_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "m boolean, w double")
    assert df.agg(ag.optional_accuracy("m", "w")).first()[0] is None


def test_stability_defaults(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("b", 0.5), ("c", None)], "k string, v double")
    assert dict(rows_of(df.groupBy("k").agg(ag.stability("v", 0.1)))) == {"a": 0.58, "b": 1.0, "c": None}


def test_robust_outliers_of_equal_values(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(9)] + [("a", 9, 2.0), ("a", 10, None)], "k string, id int, v double")
    assert [(r.id, round(r.z)) for r in ag.robust_outliers(df, ["k"], "v").collect()] == [(9, 50)]


def test_weighted_quantile_is_held_at_the_ends(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 1.0), ("a", 3.0, 2.0), ("a", float("nan"), 1.0), ("a", 9.0, 0.0)], "k string, v double, w double")
    got = {r.q: r.value for r in ag.weighted_quantiles(df, ["k"], "v", "w", [0.0, 0.5, 1.0]).collect()}
    assert got[0.0] == 1.0 and got[1.0] == 3.0 and got[0.5] == pytest.approx(1.0 + 2.0 * (2 - 1) / 3)


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0), ("c", 3.0, None)], "k string, x double, y double")
    got = dict(rows_of(df.groupBy("k").agg(ag.correlation("x", "y"))))
    assert got["a"] is None and got["b"] is None and got["c"] == pytest.approx(1.0)


def test_dominant_takes_the_smaller_name_of_equals(spark):
    df = spark.createDataFrame([("r", "b"), ("r", "a"), ("s", None)], "k string, v string")
    assert rows_of(ag.dominant(df, ["k"], "v")) == [("r", "a", 0.5)]


def test_entropy(spark):
    df = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "a")], "k string, v string")
    assert {r.k: (r.entropy, r.purity) for r in ag.entropy(df, ["k"], "v").collect()} == {"r": (1.0, 0.0), "s": (0.0, 1.0)}


def test_reasons_without_blanks_and_ready_marks(spark):
    df = spark.createDataFrame([(["a ", "A", None, "", "x_ready"],), (None,)], "reasons array<string>")
    assert rows_of(ag.reason_counts(df, "reasons")) == [("A", 2)]


def test_quota_pass_like_the_scan(spark):
    import random

    rng = random.Random(3)
    rows = [(f"g{g}", f"i{i:03}", rng.choice([None, 0.1, 0.5, 0.5, 0.8, 0.9]), rng.choice(["PASS", "WARN", "FAIL"]), rng.random() < 0.1, rng.random() < 0.2) for g, n in enumerate((5, 8, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, image string, score double, status string, fails boolean, guarded boolean")
    got = {(r.g, r.image): r.final_status for r in ranking.quota_pass(df, ["g"], "score", "image", "status", F.col("fails"), F.col("guarded"), 0.08).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        quota, used = (len(own) if len(own) < 8 else max(1, -(-len(own) * 8 // 100))), 0
        for _, image, _, state, fails, guarded in own:
            if fails:
                state = "FAIL"
            elif state == "PASS" and guarded:
                state = "WARN"
            elif state == "PASS":
                used += 1
                state = "PASS" if used <= quota else "WARN"
            want[g, image] = state
    assert got == want


def test_ranks_put_null_scores_last(spark):
    df = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 1.0), ("g", "c", None)], "g string, image string, score double")
    assert [(r.image, r["rank"]) for r in ranking.rank_within(df, ["g"], "score", "image").orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_rank_stability_of_one_row(spark):
    df = spark.createDataFrame([("g", "a", 0.5), ("h", "a", 0.9), ("h", "b", 0.89), ("h", "c", None)], "g string, image string, score double")
    got = {r.g: (r.band, r.cluster_count) for r in ranking.rank_stability(df, ["g"], "score", "image").collect()}
    assert got == {"g": ("UNAVAILABLE", 1), "h": ("TIGHT", 2)}


def test_path_then_unique_name(spark):
    entries = spark.createDataFrame([(1, "in/a.png"), (2, "IN\\A.png"), (3, "x/b.png"), (4, "y/b.png"), (5, "z/c.png"), (6, None)], "id int, path string")
    rows = spark.createDataFrame([("in/a.png",), ("q/b.png",), ("q/c.png",), (None,)], "p string")
    got = {r.p: (r.entry and r.entry.id, r.matched_by) for r in joins.resolve_by_path_or_name(rows, "p", entries, "path", "id").collect()}
    assert got == {"in/a.png": (2, "path"), "q/b.png": (None, None), "q/c.png": (5, "name"), None: (None, None)}


def test_fill_counts_what_it_filled(spark):
    base = spark.createDataFrame([("a", " ", "k"), ("b", None, None), ("c", "v", None)], "k string, x string, y string")
    new = spark.createDataFrame([("a", "n", "m"), ("b", None, "m"), ("d", "z", "z")], "k string, x string, y string")
    assert rows_of(joins.fill_missing(base, new, ["k"], ["x", "y"])) == [("a", "n", "k", 1), ("b", None, "m", 1), ("c", "v", None, 0)]
    assert rows_of(joins.unmatched(new, base, ["k"]).select("k")) == [("d",)]


def test_upsert_prefers_the_change(spark):
    old, new = spark.createDataFrame([("a", 1, "o"), ("b", 5, "o")], "k string, v int, x string"), spark.createDataFrame([("a", 1, "n"), ("b", 4, "n"), ("c", None, "n")], "k string, v int, x string")
    assert rows_of(joins.upsert(old, new, ["k"], "v")) == [("a", 1, "n"), ("b", 5, "o"), ("c", None, "n")]


def test_fallback_levels(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("c", None)], "k string, l int")
    assert rows_of(joins.with_fallback_levels(df, ["k"], F.col("l")).select("k", "l")) == [("a", 1), ("b", 3)]


def test_sets_keep_order_and_nulls_read_as_empty(spark):
    df = spark.createDataFrame([(["b", " a", "b ", "", None],), (None,)], "r array<string>")
    assert [r[0] for r in df.select(sets.ordered_distinct("r")).collect()] == [["b", "a"], []]
    assert [r[0] for r in df.select(sets.must_have_missing(F.array(F.lit("a"), F.lit("z")), "r")).collect()] == [["z"], ["a", "z"]]


def test_first_map_wins(spark):
    df = spark.createDataFrame([({"a": 1.0}, {"a": 2.0, "b": 3.0}), (None, {"b": 1.0})], "x map<string,double>, y map<string,double>")
    assert [r[0] for r in df.select(sets.first_wins("x", "y")).collect()] == [{"a": 1.0, "b": 3.0}, {"b": 1.0}]


def test_cycles_and_dangling_edges(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "f"), ("x", "a"), ("a", "y")], "source_id string, target_id string")
    assert rows_of(graph.dangling_edges(nodes, edges)) == [("SOURCE_MISSING", "x"), ("TARGET_MISSING", "y")]
    assert rows_of(graph.nodes_on_or_behind_cycles(nodes, edges)) == [("b",), ("c",), ("d",)]
    assert graph.nodes_on_or_behind_cycles(nodes, edges.limit(0)).count() == 0


def test_replay_against_a_loop(spark):
    rows = [("PASS", 0.8), ("WARN", 0.6), ("FAIL", 0.2), ("WARN", 0.75), ("PASS", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "status string, s double, w double")
    trials = replay.grid_trials(p=[0.7, 0.78], q=[0.5])
    predicted = F.when(F.col("s") >= F.col("trial.p"), "PASS").when(F.col("s") >= F.col("trial.q"), "WARN").otherwise("FAIL")
    got = {r.trial: r.accuracy for r in replay.replay(df, trials, predicted, "status", "w").collect()}
    assert got == {0: pytest.approx(3 / 5), 1: pytest.approx(4 / 5)}


def test_overrides_are_typed():
    assert replay.apply_overrides({"a.b": 1, "c": 0.5}, {"a.b": 2}) == {"a.b": 2, "c": 0.5}
    with pytest.raises(KeyError):
        replay.apply_overrides({"a": 1}, {"b": 1})
    with pytest.raises(TypeError):
        replay.apply_overrides({"a": 1}, {"a": True})


def test_trees_and_spaces():
    assert replay.merge_trees({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert replay.set_path({"a": {"b": 1}}, "a.c.d", 2) == {"a": {"b": 1, "c": {"d": 2}}}
    assert replay.get_path({"a": {"b": 1}}, "a.x", 7) == 7
    assert replay.space_issues([{"name": "x", "type": "float", "low": 1, "high": 0}, {"name": "x", "type": "bad"}]) == ["BOUNDS_INVALID:x", "NAME_MISSING_OR_REPEATED:x", "TYPE_UNKNOWN:x"]


def test_trial_summary_of_the_published_fixture(spark):
    rows = [("s", "jpeg_roundtrip", 0.1, "face_a", "face_a"), ("s", "jpeg_roundtrip", 0.2, "face_a", "face_b"), ("s", "crop_translation", None, None, None)]
    df = spark.createDataFrame(rows, "source string, family string, residual double, base string, trial string")
    whole = repeatability.trial_summary(df, ["source"], "family", "residual").filter("level = 'all'").first()
    assert (whole.trials, whole.n, whole["median"], whole.spread) == (3, 2, pytest.approx(0.15), pytest.approx(0.1))
    assert rows_of(repeatability.chain_transitions(df, ["source"], "base", "trial")) == [("s", 2, 1)]


def test_pairwise_median_and_cohesion(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("a", 3, [1.0, 1.0]), ("b", 4, [1.0, 0.0]), ("c", 5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, id int, v array<double>").withColumn("w", F.lit(1.0))
    got = {r.g: (r.pairs, r["median"]) for r in cohesion.pairwise_medians(df, "g", "id", "v").collect()}
    assert got["a"] == (3, pytest.approx(0.70711, abs=1e-5)) and "c" not in got
    assert {r.g for r in cohesion.cohesion(df, "g", "id", "v", "w", 2).collect()} == {"a", "b"}
    many = spark.createDataFrame([("h", i, [float(i % 7), 1.0]) for i in range(300)], "g string, id int, v array<double>")
    assert cohesion.pairwise_medians(many, "g", "id", "v", block=50).first()["median"] == pytest.approx(cohesion.pairwise_medians(many, "g", "id", "v").first()["median"])


def test_labels_that_cannot_be_read_raise(spark):
    from plumbline.sources.readers import normalise_labels

    schema = "image string, expected_status string, status string, weight double, must_have_reasons array<string>, must_not_have_reasons array<string>"
    good = normalise_labels(spark.createDataFrame([("a", " pass", None, None, ["x", "x"], None)], schema)).first()
    assert (good.expected_status, good.weight, good.must_have_reasons, good.must_not_have_reasons) == ("PASS", 1.0, ["x"], [])
    for bad in (("a", "NO", None, 1.0), ("a", "PASS", None, -1.0), ("", "PASS", None, 1.0), ("a", "PASS", None, float("nan"))):
        with pytest.raises(PySparkException):
            normalise_labels(spark.createDataFrame([(*bad, None, None)], schema)).collect()
