import random
import statistics

import pytest
from pyspark.sql import functions as F

from heftmap.operators import paired as Q
from heftmap.operators.ranks import exact_medians, running_totals

random.seed(11)
VALUES = [(random.choice("abc"), round(random.gauss(0, 5), random.choice((0, 3))), random.random() < 0.4) for _ in range(3000)]
VALUES += [("hot", float(i % 7), True) for i in range(3000)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(VALUES, "k string, x double, p boolean").repartition(7)


@pytest.mark.parametrize("one_slice_rows", [10, 100_000])
def test_running_totals(rows, one_slice_rows):
    counted = rows.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    got = running_totals(counted, "x", ["n"], ["k"], one_slice_rows=one_slice_rows, slices=16).collect()
    for r in got:
        assert r["n_through"] == sum(1 for k, x, _ in VALUES if k == r["k"] and x <= r["x"])
        assert r["n_total"] == sum(1 for k, _, _ in VALUES if k == r["k"])
    assert len(got) == len({(k, x) for k, x, _ in VALUES})


@pytest.mark.parametrize("one_slice_rows", [10, 100_000])
def test_medians(rows, one_slice_rows):
    measures = {"m": F.col("x"), "neg": -F.col("x")}
    for r in exact_medians(rows, measures, ["k"], one_slice_rows=one_slice_rows, slices=16).collect():
        xs = [x for k, x, _ in VALUES if k == r["k"]]
        assert r["m"] == pytest.approx(statistics.median(xs)) and r["neg"] == pytest.approx(-statistics.median(xs))
    whole = exact_medians(rows, measures, one_slice_rows=one_slice_rows, slices=16).first()
    assert whole["m"] == pytest.approx(statistics.median(x for _, x, _ in VALUES))


def brute_threshold(values):
    xs = sorted({x for _, x, _ in values})
    best, best_t = -1, None
    for a, b in zip(xs, xs[1:]):
        t = (a + b) / 2
        right = sum((x >= t) == p for _, x, p in values)
        if right > best:
            best, best_t = right, t
    return best_t, best / len(values)


@pytest.mark.parametrize("one_slice_rows", [10, 100_000])
def test_best_threshold(rows, one_slice_rows):
    got = Q.best_threshold(rows, "x", F.col("p"), one_slice_rows=one_slice_rows).first()
    t, accuracy = brute_threshold(VALUES)
    assert got["threshold"] == pytest.approx(t) and got["accuracy"] == pytest.approx(accuracy)


def test_best_threshold_needs_two_classes(spark):
    rows = spark.createDataFrame([(1.0, True), (2.0, True)], "x double, p boolean")
    assert Q.best_threshold(rows, "x", F.col("p")).count() == 0


def test_grid(rows):
    xs = [x for _, x, _ in VALUES]
    lo, hi = min(xs), max(xs)
    for r in Q.grid_counts(rows, "x", F.col("p"), steps=50).collect():
        t = lo + (hi - lo) * (r["step"] / 50)
        assert r["correct"] == sum((x >= t) == p for _, x, p in VALUES)


def test_grid_of_one_value_and_without_positives(spark):
    flat = spark.createDataFrame([(3.0, True), (3.0, False), (3.0, True)], "x double, p boolean")
    got = Q.grid_threshold(flat, "x", F.col("p")).first()
    assert (got["threshold"], got["accuracy"], got["verdict"]) == (3.0, 2 / 3, "fail")
    none = spark.createDataFrame([(1.0, False), (2.0, False)], "x double, p boolean")
    assert Q.grid_threshold(none, "x", F.col("p")).first()["verdict"] == "no_decision"


@pytest.fixture(scope="module")
def pairs(spark):
    a = spark.createDataFrame([("w_Color", 0.5, 10.0), ("x_Normal", 0.25, 20.0), ("y_Color", 0.75, 30.0), ("only_a", 0.1, 1.0)], "label string, ratio double, hp_energy double")
    b = spark.createDataFrame([("w_Color", 0.5, 0.0), ("x_Normal", 0.5, 0.0), ("y_Color", 0.25, 0.0), ("only_b", 0.1, 0.0)], "label string, ratio double, hp_energy double")
    return Q.oracle_rows(Q.pair_benchmarks(a, b))


def test_pairs(pairs):
    got = {r["label"]: (r["winner"], r["oracle_ratio"]) for r in pairs.collect()}
    assert got == {"w_Color": ("bilinear", 0.5), "x_Normal": ("bilinear", 0.25), "y_Color": ("learned", 0.25)}
    summary = Q.oracle_summary(pairs).first()
    assert (summary["n"], summary["a_wins"], summary["b_wins"], summary["a_median"], summary["oracle_median"]) == (3, 2, 1, 0.5, 0.25)
    lift = Q.oracle_lift(Q.oracle_summary(pairs)).first()
    assert lift["lift_abs"] == 0.25 and lift["lift_pct"] == 50.0 and lift["worthwhile"]
    by_class = {r["content_class"]: r["oracle_median"] for r in Q.oracle_by_class(pairs).collect()}
    assert by_class == {"color": 0.375, "normal": 0.25}
    ranges = {r["winner"]: (r["feature_min"], r["feature_max"], r["feature_median"]) for r in Q.feature_range_by_winner(pairs).collect()}
    assert ranges == {"bilinear": (10.0, 20.0, 15.0), "learned": (30.0, 30.0, 30.0)}


def test_gates(spark):
    costs = spark.createDataFrame([(0.5,), (1.0,), (1.5,)], "ratio double")
    got = Q.router_gate(costs).first()
    assert (got["codec_wins"], got["backup_wins"], got["headroom_is_real"]) == (1, 2, True)
    assert got["always_codec"] == pytest.approx(1.0) and got["perfect"] == pytest.approx(2.5 / 3)
    runs = spark.createDataFrame([(1, True, 0.4), (1, True, 0.3), (1, False, 0.1), (2, True, 0.05)], "quant_step int, byte_exact boolean, ratio double")
    assert Q.best_lossless(runs).first().asDict() == {"best_ratio": 0.3, "lossless_runs": 2, "total_runs": 4}
    assert Q.lossless_rate(runs).first().asDict() == {"passed": 2, "total": 3, "rate": 2 / 3}
    assert Q.best_lossless(runs.where("quant_step = 2")).first()["best_ratio"] == 0.0
