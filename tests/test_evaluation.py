"""Metrics, calibration, thresholds and bootstrap against plain-Python definitions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from visitline.functions import probability as P
from visitline.functions.ordered import exact_quantiles, running_sums, with_value_bucket
from visitline.operators import bootstrap as B, integrity as I, metrics as M, selective as V

PROB = "prob"


def frame(spark, data):
    return spark.createDataFrame([(int(y), [float(x) for x in p]) for y, p in data], "y int, prob array<double>")


def random_predictions(n, seed, classes=3, grid=None):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = [rng.random() + 0.01 if grid is None else rng.randrange(1, grid) for _ in range(classes)]
        out.append((rng.randrange(classes), [x / sum(w) for x in w]))
    return out


def brute_auc(pos, neg):
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("grid", [None, 4])
def test_multiclass_metrics(spark, grid):
    data = random_predictions(240, 3, grid=grid)
    got = M.multiclass_metrics(frame(spark, data), "y", PROB).first()
    y = [t for t, _ in data]
    pred = [p.index(max(p)) for _, p in data]
    n = len(data)
    assert got["accuracy"] == pytest.approx(sum(a == b for a, b in zip(y, pred)) / n)
    auc = np.mean([brute_auc([p[k] for t, p in data if t == k], [p[k] for t, p in data if t != k]) for k in range(3)])
    assert got["roc_auc_ovr"] == pytest.approx(auc)
    assert got["log_loss"] == pytest.approx(np.mean([-math.log(p[t]) for t, p in data]))
    assert got["brier_score"] == pytest.approx(np.mean([sum((p[k] - (k == t)) ** 2 for k in range(3)) for t, p in data]))
    f1 = []
    for k in range(3):
        tp = sum(a == b == k for a, b in zip(y, pred))
        f1.append(2 * tp / (y.count(k) + pred.count(k)))
        assert got[f"f1_class_{k}"] == pytest.approx(f1[-1])
    assert got["macro_f1"] == pytest.approx(np.mean(f1))


def test_perfect_predictions(spark):
    data = [(k, [0.8 if j == k else 0.1 for j in range(3)]) for k in (0, 0, 1, 1, 2, 2)]
    got = M.multiclass_metrics(frame(spark, data), "y", PROB).first()
    assert [list(r) for r in got["confusion_matrix"]] == [[2, 0, 0], [0, 2, 0], [0, 0, 2]]
    assert got["accuracy"] == got["macro_f1"] == got["cohen_kappa"] == got["roc_auc_ovr"] == 1.0
    assert got["log_loss"] >= 0 and got["brier_score"] >= 0


def test_absent_classes(spark):
    data = [(0, [0.5, 0.2, 0.3]), (2, [0.2, 0.6, 0.2]), (0, [0.6, 0.3, 0.1])]
    got = M.multiclass_metrics(frame(spark, data), "y", PROB).first()
    assert got["roc_auc_ovr"] == 1.0  # class 1 scores separate label 2 from label 0
    assert got["balanced_accuracy"] == pytest.approx(0.5)  # classes in the truth only
    assert got["macro_f1"] == pytest.approx((1.0 + 0.0 + 0.0) / 3)  # class 1 was predicted
    single = M.multiclass_metrics(frame(spark, [(1, [0.2, 0.5, 0.3])]), "y", PROB).first()
    assert single["roc_auc_ovr"] is None and single["cohen_kappa"] is None


def test_zero_probability_is_clipped(spark):
    got = M.multiclass_metrics(frame(spark, [(0, [0.0, 1.0, 0.0]), (1, [0.0, 1.0, 0.0])]), "y", PROB).first()
    assert got["log_loss"] == pytest.approx(-math.log(2.220446049250313e-16) / 2)


def test_binary_metrics(spark):
    rng = random.Random(5)
    data = [(rng.randrange(2), rng.randrange(20) / 20) for _ in range(300)]
    got = M.binary_metrics(spark.createDataFrame(data, "y int, s double"), "y", "s").first()
    pos, neg = [s for t, s in data if t], [s for t, s in data if not t]
    assert got["roc_auc"] == pytest.approx(brute_auc(pos, neg))
    ap, seen, hits = 0.0, 0, 0
    for s in sorted({s for _, s in data}, reverse=True):
        at = [t for t, v in data if v == s]
        seen, hits = seen + len(at), hits + sum(at)
        ap += sum(at) / len(pos) * hits / seen
    assert got["pr_auc"] == pytest.approx(ap)
    assert got["sensitivity"] == pytest.approx(sum(s >= 0.5 for s in pos) / len(pos))
    assert got["specificity"] == pytest.approx(sum(s < 0.5 for s in neg) / len(neg))


def test_binary_metrics_without_one_class(spark):
    got = M.binary_metrics(spark.createDataFrame([(1, 0.9), (1, 0.8)], "y int, s double"), "y", "s").first()
    assert got["roc_auc"] is None and got["pr_auc"] is None and got["specificity"] is None and got["npv"] is None
    assert got["accuracy"] == 1.0 and got["sensitivity"] == 1.0


def test_calibration_bin_edges(spark):
    df = frame(spark, [(0, [0.1, 0.9, 0.0]), (1, [0.0, 1.0, 0.0])])
    got = {(r["class_id"], r["bin"]): r["n"] for r in M.calibration_bins(df, "y", F.col(PROB)).collect()}
    assert got == {(0, 1): 1, (0, 0): 1, (1, 9): 2, (2, 0): 2}
    edges = spark.createDataFrame([(0.0,), (0.1,), (0.1000001,), (0.30000000000000004,), (1.0,)], "s double")
    assert [r[0] for r in edges.select(M.right_closed_bin(F.col("s"), 10)).collect()] == [0, 1, 2, 3, 10]


def brute_ece(scores, hits, bins=10):
    edges = np.linspace(0, 1, bins + 1)
    s, h, out = np.array(scores), np.array(hits, dtype=float), 0.0
    for i in range(bins):
        m = (s > edges[i]) & (s <= edges[i + 1])
        if m.any():
            out += m.mean() * abs(h[m].mean() - s[m].mean())
    return out


def test_calibration_errors(spark):
    data = random_predictions(300, 11, grid=6)
    df = frame(spark, data)
    conf = [max(p) for _, p in data]
    hit = [p.index(max(p)) == t for t, p in data]
    assert M.expected_calibration_error(df, "y", F.col(PROB)).first()["ece"] == pytest.approx(brute_ece(conf, hit))
    classwise = {r["class_id"]: r["classwise_ece"] for r in M.classwise_calibration_error(df, "y", F.col(PROB)).collect()}
    for k in range(3):
        assert classwise[k] == pytest.approx(brute_ece([p[k] for _, p in data], [t == k for t, _ in data]))


@pytest.mark.parametrize("scale", [1.0, 1e-7, 1e9])
def test_exact_quantiles(spark, scale):
    rng = random.Random(2)
    values = [rng.choice([rng.random(), rng.lognormvariate(0, 3), 0.5]) * scale for _ in range(501)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "g int, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    for r in exact_quantiles(df, "v", probs, names, ["g"]).collect():
        own = [v for i, v in enumerate(values) if i % 2 == r["g"]]
        assert [r[n] for n in names] == pytest.approx(list(np.quantile(own, probs)), rel=1e-12)


def test_running_sums_cross_buckets(spark):
    values = sorted({random.Random(4).random() ** 4 for _ in range(1)} | {i ** 3 / 1000 for i in range(200)})
    df = with_value_bucket(spark.createDataFrame([(v, 1) for v in values], "v double, n int"), "v", limit=8)
    assert df.select("_bucket").distinct().count() > 10
    got = running_sums(df, ["v"], ["n"]).orderBy("v").collect()
    assert [r["n_before"] for r in got] == list(range(len(values))) and got[0]["n_total"] == len(values)


def test_coverage_falls_with_the_threshold(spark):
    data = [(0, [0.9, 0.05, 0.05]), (0, [0.5, 0.3, 0.2]), (1, [0.2, 0.6, 0.2]), (2, [0.1, 0.2, 0.7])]
    df = frame(spark, data).withColumn("split", F.lit("validation"))
    limits = V.coverage_thresholds(df, F.col(PROB), [1.0, 0.5])
    got = V.risk_coverage(df, "y", F.col(PROB), limits).orderBy("threshold").collect()
    assert [(r["target_coverage"], r["coverage"], r["n_retained"]) for r in got] == [(1.0, 1.0, 4), (0.5, 0.5, 2)]
    assert all(r["accuracy"] == 1.0 and r["error_rate"] == 0.0 for r in got)


def test_equal_thresholds_are_both_reported(spark):
    df = frame(spark, [(0, [0.6, 0.2, 0.2])] * 4).withColumn("split", F.lit("validation"))
    limits = V.coverage_thresholds(df, F.col(PROB), [1.0, 0.5])
    assert sorted(r["n_retained"] for r in V.risk_coverage(df, "y", F.col(PROB), limits).collect()) == [4, 4]


def test_uncertainty(spark):
    r = M.uncertainty_measures(frame(spark, [(0, [0.0, 0.25, 0.75])]), F.col(PROB)).first()
    assert r["max_probability"] == 0.75 and r["probability_margin"] == 0.5
    assert r["predictive_entropy"] == pytest.approx(-(0.25 * math.log(0.25) + 0.75 * math.log(0.75)))


def test_simplex(spark):
    I.assert_simplex(frame(spark, [(0, [0.2, 0.5, 0.3])]), F.col(PROB))
    with pytest.raises(ValueError):
        I.assert_simplex(frame(spark, [(0, [0.2, 0.2, 0.2])]), F.col(PROB))


def test_soft_voting(spark):
    df = spark.createDataFrame([([0.6, 0.4], [0.2, 0.8])], "a array<double>, b array<double>")
    even = df.select(P.soft_vote([F.col("a"), F.col("b")]).alias("v")).first()["v"]
    tilted = df.select(P.soft_vote([F.col("a"), F.col("b")], [3, 1]).alias("v")).first()["v"]
    assert even == pytest.approx([0.4, 0.6]) and tilted == pytest.approx([0.5, 0.5])
    for bad in ([1], [-1, 2], [0, 0]):
        with pytest.raises(ValueError):
            P.vote_weights(2, bad)
    with pytest.raises(ValueError):
        P.vote_weights(0, None)


def test_zero_calibrated_mass_keeps_the_base(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.3, 0.7]), ([0.2, 0.2], [0.3, 0.7])], "c array<double>, b array<double>")
    got = [r[0] for r in df.select(P.calibrated_or_base(F.col("c"), F.col("b"))).collect()]
    assert got[0] == pytest.approx([0.3, 0.7]) and got[1] == pytest.approx([0.5, 0.5])


def test_resampled_blocks_stay_whole(spark):
    df = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "RID int, value int")
    for seed in range(5):
        got = B.resample_blocks(df, "RID", seed)
        per = {}
        for r in got.collect():
            per.setdefault((r["RID"], r["copy"]), []).append(r["value"])
        assert len(per) == 2  # as many draws as subjects
        assert all(sorted(v) == ([10, 11] if k[0] == 1 else [20]) for k, v in per.items())


def test_bootstrap_is_seeded_and_covers_the_estimate(spark):
    data = random_predictions(60, 9, grid=5)
    df = spark.createDataFrame([(i // 2, y, p) for i, (y, p) in enumerate(data)], "RID int, truth int, prob array<double>")
    a, b = (rows(B.subject_bootstrap_ci(df, "RID", "truth", F.col(PROB), 60)) for _ in range(2))
    assert a == b
    for metric, estimate, low, high, valid, unit in a:
        assert low <= estimate <= high and valid == 60 and unit == "subject"


@pytest.mark.parametrize("called", [False, True])
def test_repetitions_equal_written_out_resamples(spark, called):
    data = random_predictions(90, 4, grid=4)
    # Subject 0 owns a third of the rows; class 2 stands for one subject only, so some resamples lack it.
    subjects = [0 if i % 3 == 0 else 1 + i % 9 for i in range(len(data))]
    data = [(s, 2 if s == 5 else y % 2, p) for s, (y, p) in zip(subjects, data)]
    df = spark.createDataFrame([*data, (1, 0, None), (None, 1, [0.2, 0.5, 0.3])], "RID int, truth int, prob array<double>")
    rule = F.when(F.get("prob", F.lit(2)) >= 0.3, 2).otherwise(0) if called else None
    got = {r["rep"]: r for r in B.repetition_metrics(df, "RID", "truth", F.col("prob"), 40, 7, predicted=rule).collect()}
    places = B.subject_places(df, "RID", 7)
    drawn = {r["subject"]: r["reps"] for r in B.draw_lists(places, 40, 7).join(places, "position").collect()}
    assert sum(len(v) for v in drawn.values()) == 40 * places.count()
    undefined = 0
    for rep in range(40):
        rows_of = [(y, p) for s, y, p in data for _ in range(drawn.get(s, []).count(rep + 1))]
        calls = [(2 if p[2] >= 0.3 else 0) if called else int(np.argmax(p)) for _, p in rows_of]
        assert got[rep]["n_rows"] == len(rows_of)
        assert got[rep]["accuracy"] == pytest.approx(np.mean([y == c for (y, _), c in zip(rows_of, calls)]))
        assert got[rep]["log_loss"] == pytest.approx(np.mean([-np.log(max(p[y], 2.220446049250313e-16)) for y, p in rows_of]))
        if {y for y, _ in rows_of} != {0, 1, 2}:
            undefined += 1
            continue
        areas = []
        for k in range(3):
            own, rest = ([p[k] for y, p in rows_of if (y == k) == side] for side in (True, False))
            areas.append(np.mean([(a > b) + (a == b) / 2 for a in own for b in rest]))
        assert got[rep]["roc_auc_ovr"] == pytest.approx(np.mean(areas))
    assert undefined


def test_hashes_of_arrays_are_those_of_the_column(spark):
    """Draws are hashed together; before, ``visitline.functions.digests`` did not exist."""
    from visitline.functions.digests import seeded_hashes
    from visitline.functions.ordered import seeded_hash

    first, second = [1, 9, 10, 99, 1000], [0, 7, 10, 12345, 10**9, 987654321012345678]
    pairs = spark.createDataFrame([(a, b) for a in first for b in second], "a long, b long")
    for seed in (42, -3, 12345678901234567890):
        wanted = {(r["a"], r["b"]): r["h"] for r in pairs.select("a", "b", seeded_hash(seed, F.col("a"), F.col("b")).alias("h")).collect()}
        got = seeded_hashes(seed, np.array(first), np.array(second)).tolist()
        assert {(a, b): got[i][j] for i, a in enumerate(first) for j, b in enumerate(second)} == wanted


def test_bootstrap_of_an_empty_table(spark):
    df = spark.createDataFrame([], "RID int, truth int, prob array<double>")
    got = B.subject_bootstrap_ci(df, "RID", "truth", F.col("prob"), 10).collect()
    assert len(got) == len(B.METRICS) and all(r["valid_repetitions"] == 0 and r["ci_lower"] is None for r in got)


def test_scoped_evaluation_lists_thin_bins(spark):
    data = [(i, 0 if i % 2 else 1, [0.6, 0.3, 0.1], f"2020-01-{1 + i % 28:02d}", i, 15.0) for i in range(30)]
    df = spark.createDataFrame(data, "RID int, y int, prob array<double>, d string, row_id int, forecast_months double")
    got = {(r["scope"], r["horizon"]): r for r in V.scoped_evaluation(df, "y", "prob", "RID", "d", "row_id").collect()}
    assert len(got) == 6
    assert got["horizon", "0-12 months"]["n_rows"] == 0 and got["horizon", "0-12 months"]["accuracy"] is None
    assert got["horizon", "12-24 months"]["stable_metrics_reported"] and got["row_level", "overall"]["accuracy"] == 0.5
    called = V.scoped_evaluation(df, "y", "prob", "RID", "d", "row_id", predicted=F.col("y")).where("scope = 'row_level'").first()
    assert called["accuracy"] == 1.0 and called["log_loss"] == got["row_level", "overall"]["log_loss"]


def test_model_selection_order(spark):
    data = [("random_forest", 0.8, 0.5, 0.2), ("logistic_regression", 0.8, 0.5, 0.2), ("new_model", 0.8, 0.5, 0.2), ("x", 0.803, 0.9, 0.9)]
    df = spark.createDataFrame(data, "model string, macro_f1 double, log_loss double, brier_score double")
    assert V.select_model(df).first()["model"] == "x"
    assert V.select_model(df.where("model <> 'x'")).first()["model"] == "logistic_regression"
    assert V.select_within_tolerance(df).first()["model"] == "logistic_regression"


def test_run_summary_uses_population_deviation(spark):
    df = spark.createDataFrame([("a", None, "0.5"), ("a", None, "0.7"), ("a", None, "x")], "model string, g string, macro_f1 string")
    got = V.summarize_runs(df, ["model", "g"], ["macro_f1"]).first()
    assert got["macro_f1_mean"] == pytest.approx(0.6) and got["macro_f1_std"] == pytest.approx(0.1)


def test_mask_drops(spark):
    df = spark.createDataFrame([(1, "none", 0.8), (1, "g", 0.6), (2, "none", 0.5), (2, "g", 0.5)], "seed int, masked_group string, macro_f1 double")
    got = {r["masked_group"]: (r["absolute_drop"], r["relative_drop"]) for r in V.mask_summary(df, ["macro_f1"]).collect()}
    assert got["g"] == pytest.approx((0.1, 0.125)) and got["none"] == (0.0, 0.0)


@pytest.mark.parametrize("kind", ["outliers", "narrow", "one value", "few values", "groups"])
def test_value_buckets_stay_below_their_limit_and_in_order(spark, kind):
    rng = random.Random(1)
    values = {
        "outliers": [rng.gauss(0, 1) for _ in range(20_000)] + [-1e300, 1e300, float("inf")],
        "narrow": [0.5 + rng.uniform(-2e-4, 2e-4) for _ in range(20_000)],
        "one value": [3.0] * 15_000 + [rng.random() for _ in range(5_000)],
        "few values": [float(i % 3) for i in range(20_000)],
        "groups": [rng.paretovariate(0.3) for _ in range(20_000)] + [None, None],
    }[kind]
    rows = [("a" if kind != "groups" else [None, "b", "c"][i % 7 % 3], v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, v double")
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    placed = with_value_bucket(counts, "v", ["g"], rows=df, limit=50)
    per_bucket = placed.groupBy("g", "_bucket").agg(F.count("*").alias("values"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    assert max(r["values"] for r in per_bucket) <= 50
    for g in {r["g"] for r in per_bucket}:
        own = sorted((r for r in per_bucket if r["g"] == g and r["low"] is not None), key=lambda r: r["_bucket"])
        assert all(x["high"] < y["low"] for x, y in zip(own, own[1:]))
        assert kind == "few values" or len(own) > 20
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "v", [0.3], ["q"], ["g"], limit=50).collect()}
    for g, q in got.items():
        assert q == pytest.approx(float(np.quantile([v for x, v in rows if x == g and v is not None], 0.3)))


def test_exact_medians_from_brackets(spark):
    from visitline.functions.ordered import exact_medians

    rng = np.random.default_rng(5)
    odd, ties = rng.normal(size=2001), rng.integers(0, 3, 2001).astype(float)
    data = [(float(a), float(b), float(a) if i else None, float("nan") if i % 2 else float(b)) for i, (a, b) in enumerate(zip(odd, ties))]
    df = spark.createDataFrame(data, "odd double, ties double, even double, gaps double").repartition(5)
    wanted = {c: float(np.nanmedian(np.array([r[i] for r in data], dtype=float))) for i, c in enumerate(("odd", "ties", "even", "gaps"))}
    near = {c: (v - 0.01, v + 0.01) for c, v in wanted.items()}
    assert exact_medians(df, near) == wanted
    assert exact_medians(df, {c: (50.0, 60.0) for c in wanted}) == wanted  # borders that miss the middle


def test_auc_over_tasks_and_batches(spark):
    """Groups that span tasks and batches, ties, a null group and weights, next to all pairs of rows."""
    rng = np.random.default_rng(9)
    prob = rng.integers(0, 40, (600, 3)) / 40.0
    truth, weight = rng.integers(0, 3, 600), rng.integers(1, 4, 600)
    group = [("a", None)[i % 2] for i in range(600)]
    rows = [(group[i], int(truth[i]), [float(x) for x in prob[i]], int(weight[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, y int, prob array<double>, w int").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r["g"]: r["roc_auc_ovr"] for r in M.auc_ovr(df, "y", F.col("prob"), [0, 1, 2], ["g"], F.col("w")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for g in ("a", None):
        own = np.array([x == g for x in group])
        areas = []
        for k in range(3):
            s, y, w = prob[own, k], truth[own] == k, weight[own]
            wins = (s[y][:, None] > s[~y][None, :]) + 0.5 * (s[y][:, None] == s[~y][None, :])
            areas.append((wins * w[y][:, None] * w[~y][None, :]).sum() / (w[y].sum() * w[~y].sum()))
        assert got[g] == pytest.approx(np.mean(areas))
