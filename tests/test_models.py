"""Preparation, fitting, calibration and training flows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.conftest import rows
from visitline.operators import experiments as X, models as M
from visitline.sources import sinks as K

LR = {"logistic_regression": {"max_iter": 20}}


@pytest.fixture(scope="module")
def subjects(spark):
    """Three visits per subject; `signal` tells the label, `noise` does not, `level` partly does."""
    rng = random.Random(0)
    data = []
    for s in range(90):
        label = s % 3
        for v in range(3):
            data.append((s, len(data), label, label + rng.gauss(0, 0.5), None if rng.random() < 0.2 else rng.gauss(0, 1),
                         rng.choice("abc") if rng.random() < 0.3 else "abc"[label]))
    df = spark.createDataFrame(data, "subject int, row_id int, label int, signal double, noise double, level string")
    return df.cache()


FEATURES = ["signal", "noise", "level"]


def test_median_and_indicator(spark):
    train = spark.createDataFrame([(1.0,), (None,), (3.0,)], "value double")
    plain, flagged = M.fit_preparation(train, ["value"]), M.fit_preparation(train, ["value"], True)
    assert (plain.width, flagged.width) == (1, 2)
    assert plain.numeric["value"][0] == 2.0
    assert plain.numeric["value"][2] == pytest.approx(math.sqrt(2 / 3))  # population deviation
    out = train
    for stage in flagged.stages():
        out = stage.transform(out)
    assert [list(r["features"]) for r in out.collect()][1] == pytest.approx([0.0, (1 - 1 / 3) / math.sqrt(2 / 9)])


def test_unknown_level_and_quotes(spark):
    train = spark.createDataFrame([(1.0, "it's"), (2.0, "b"), (None, "b"), (5.0, None)], "age double, sex string")
    prep = M.fit_preparation(train, ["age", "sex"])
    assert prep.categorical["sex"] == ("b", ["b", "it's"])
    out = spark.createDataFrame([(2.0, "X"), (2.0, "it's"), (2.0, None)], "age double, sex string")
    for stage in prep.stages():
        out = stage.transform(out)
    assert [list(r["features"])[1:] for r in out.collect()] == [[0.0, 0.0], [0.0, 1.0], [1.0, 0.0]]


def test_empty_and_constant_columns(spark):
    train = spark.createDataFrame([(None, 5.0), (None, 5.0)], "gone double, flat double")
    prep = M.fit_preparation(train, ["gone", "flat"], True)
    assert prep.dropped == ("gone",) and prep.width == 1
    out = train
    for stage in prep.stages():
        out = stage.transform(out)
    assert list(out.first()["features"]) == [0.0]


def test_logistic_regression_reaches_the_penalised_optimum(spark):
    """The stationarity condition of C * sum(w * loss) + |b|^2 / 2."""
    rng = random.Random(1)
    data = [(float(x), int(x + rng.gauss(0, 1) > 0.3)) for x in [rng.gauss(0, 1) for _ in range(200)]]
    df = spark.createDataFrame(data, "x double, label int")
    model = M.fit_model(df, ["x"], "label", "logistic_regression", {"C": 0.05, "max_iter": 200}, n_classes=2)
    scored = M.score(model, df).select("x", "label", F.get("prob", F.lit(1)).alias("p")).collect()
    prep = M.fit_preparation(df, ["x"]).numeric["x"]
    n1 = sum(r["label"] for r in scored)
    weight = {1: 200 / (2 * n1), 0: 200 / (2 * (200 - n1))}
    beta = float(model.stages[-1].coefficients[0])
    gradient = 0.05 * sum(weight[r["label"]] * (r["p"] - r["label"]) * (r["x"] - prep[1]) / prep[2] for r in scored) + beta
    assert abs(gradient) < 1e-3


@pytest.mark.parametrize("name, params", [
    ("logistic_regression", {"max_iter": 20}), ("random_forest", {"n_estimators": 5, "max_depth": 4}),
    ("hist_gradient_boosting", {"max_iter": 3, "max_leaf_nodes": 8}), ("mlp_sklearn", {"hidden_layer_sizes": [4], "max_iter": 30}),
])
def test_models_learn_save_and_load(spark, subjects, tmp_path, name, params):
    model = M.fit_model(subjects, FEATURES, "label", name, params)
    path = str(tmp_path / name)
    K.save_model(model, path)
    scored = M.score(K.load_model(path), subjects)
    assert scored.columns == [*subjects.columns, "prob"]
    frame = M.prediction_frame(scored, ["row_id", "label"], ["a", "b", "c"]).collect()
    assert all(abs(r["prob_a"] + r["prob_b"] + r["prob_c"] - 1) < 1e-8 for r in frame)
    assert sum(r["label"] == r["predicted_label"] for r in frame) / len(frame) > 0.6


def test_voting_is_the_weighted_mean(spark, subjects):
    params = {**LR, "random_forest": {"n_estimators": 3, "max_depth": 3}}
    members = M.fit_voting(subjects, FEATURES, "label", list(params), params)
    both = rows(M.score(members, subjects, [3, 1]), "row_id", "prob")
    each = [dict(rows(M.score(m, subjects), "row_id", "prob")) for m in members.values()]
    for key, p in both[:20]:
        assert list(p) == pytest.approx([0.75 * a + 0.25 * b for a, b in zip(each[0][key], each[1][key])])


def test_unsupported_model(spark, subjects):
    with pytest.raises(ValueError):
        M.fit_model(subjects, FEATURES, "label", "nope")


def test_levels_without_a_limit(spark):
    # 150,000 levels, of which the even ones belong to one class
    train = spark.range(300_000).selectExpr("concat('L', id % 150000) AS level", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 2 AS INT) AS label")
    prep = M.fit_preparation(train, ["x", "level"])
    assert prep.width == 150_001 and prep.categorical["level"][1][:3] == ["L0", "L1", "L10"]
    model = M.fit_model(train, ["x", "level"], "label", "logistic_regression", {"max_iter": 20, "C": 100.0}, n_classes=2, preparation=prep)
    probe = spark.createDataFrame([(1.0, "L4"), (1.0, "L149999"), (1.0, "new")], "x double, level string")
    even, odd, new = (r["prob"] for r in M.score(model, probe).collect())
    assert even[0] > 0.9 and odd[1] > 0.9 and abs(new[0] - 0.5) < 0.4
    out = probe
    for stage in prep.stages():
        out = stage.transform(out)
    assert [v["features"].numNonzeros() for v in out.collect()] == [2, 2, 1]


def test_scoring_a_frame_without_a_feature(spark, subjects):
    model = M.fit_model(subjects, FEATURES, "label", "logistic_regression", LR["logistic_regression"])
    got = M.score_frozen(model, subjects.drop("level"), M.frozen_schema(subjects, FEATURES), keep=["row_id"])
    assert got.count() == subjects.count() and got.columns == ["row_id", *FEATURES, "prob"]


def pava(points):
    """Weighted isotonic fit of (score, rate, weight) by pooling."""
    blocks = []
    for s, y, w in sorted(points):
        blocks.append([y, w, [s]])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            y2, w2, s2 = blocks.pop()
            y1, w1, s1 = blocks.pop()
            blocks.append([(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, s1 + s2])
    return {s: b[0] for b in blocks for s in b[2]}


def test_isotonic_calibration_matches_pooling(spark):
    rng = random.Random(6)
    data = []
    for _ in range(200):
        w = [rng.randrange(1, 5) for _ in range(3)]
        data.append((rng.randrange(3), [x / sum(w) for x in w]))
    df = spark.createDataFrame(data, "label int, prob array<double>")
    got = M.fit_calibration(df, "label", "isotonic").apply(df).collect()
    fits = []
    for k in range(3):
        cells = {}
        for y, p in data:
            hit, n = cells.get(p[k], (0, 0))
            cells[p[k]] = (hit + (y == k), n + 1)
        fits.append(pava([(s, h / n, n) for s, (h, n) in cells.items()]))
    for (y, p), r in zip(data, got):
        raw = [fits[k][p[k]] for k in range(3)]
        want = [x / sum(raw) for x in raw] if sum(raw) > 0 else p
        assert list(r["prob"]) == pytest.approx(want, abs=1e-9)


def test_calibration_table(spark, subjects):
    model = M.fit_model(subjects, FEATURES, "label", "random_forest", {"n_estimators": 3, "max_depth": 3})
    scored = M.score(model, subjects).withColumn("split", F.when(F.col("subject") < 60, "validation").otherwise("temporal_test"))
    table, fitted = M.calibrate_and_select(scored, "label")
    got = table.collect()
    assert len(got) == 6 and set(fitted) == set(M.CALIBRATION_METHODS)
    best = min((r for r in got if r["split"] == "validation"), key=lambda r: (r["log_loss"], r["brier_score"]))["method"]
    assert {r["method"] for r in got if r["selected_on_validation"]} == {best}
    with pytest.raises(ValueError):
        M.fit_calibration(scored, "label", "other")


def test_importance_finds_the_signal(spark, subjects):
    model = M.fit_model(subjects, FEATURES, "label", "logistic_regression", LR["logistic_regression"])
    got = {r["feature"]: r["importance"] for r in X.permutation_importance(model, subjects, FEATURES, "label", "row_id", 2).collect()}
    assert set(got) == set(FEATURES)
    assert got["signal"] > 0.1 and got["signal"] > got["noise"] and abs(got["noise"]) < 0.1


def test_masking_the_signal_costs_most(spark, subjects):
    groups = {"signal": ["signal", "level"], "noise": ["noise"]}
    table = X.masked_robustness(subjects, FEATURES, groups, "subject", "label", params=LR["logistic_regression"])
    drop = {r["masked_group"]: r["absolute_drop"] for r in table.collect()}
    assert drop["none"] == 0.0 and drop["signal"] > drop["noise"]


def test_sweep_and_summary(spark, subjects):
    sweep = X.seed_sweep(subjects, {"all": FEATURES}, "subject", "label", LR, (1, 2), (False, True))
    table = X.sweep_table(sweep)
    got = table.collect()
    assert len(got) == 4 and all(r["n_subjects"] == 18 and r["n_visits"] == 54 for r in got)
    assert len(X.sweep_summary(table, ["model", "missing_indicators"]).collect()) == 2


def test_tuning_never_sees_a_test_split():
    import inspect

    assert not any("test" in p for p in inspect.signature(X.tune_model).parameters)


def test_tuning_ranks_candidates(spark, subjects):
    grid = [{"C": 1e-6, "max_iter": 10}, {"C": 1.0, "max_iter": 10}]
    got = X.tune_model(subjects, FEATURES, "label", "logistic_regression", grid, validation=subjects, metric="log_loss").collect()
    assert [r["trial"] for r in got] == [1, 0]
    folds = X.tune_model(subjects, FEATURES, "label", "logistic_regression", grid[1:], subject="subject", n_splits=3).collect()
    assert len(folds) == 1 and folds[0]["value"] > 0.5
    for bad in (dict(metric="x", validation=subjects), dict()):
        with pytest.raises(ValueError):
            X.tune_model(subjects, FEATURES, "label", "logistic_regression", grid, **bad)
    with pytest.raises(ValueError, match="search space"):
        X.tune_model(subjects, FEATURES, "label", "mlp_sklearn", validation=subjects)


def test_sampled_parameters_stay_in_range():
    rng = random.Random(1)
    for space in X.SEARCH_SPACES.values():
        for _ in range(50):
            for key, value in X.sample_params(space, rng).items():
                spec = space[key]
                assert value in spec if isinstance(spec, list) else spec[0] <= value <= spec[1]


def test_ablation_features():
    got = X.ablation_features(["a"])
    assert got["features_only"] == ["a"] and got["features_plus_source_forecast"] == ["a", "source_state", "forecast_months"]
    assert len(got) == 4


def test_plain_levels_are_cells_and_odd_ones_indices(spark):
    train = spark.createDataFrame([(1.0, "a b", "x'${y}"), (2.0, "c", "__THIS__"), (4.0, None, "x'${y}")], "n double, plain string, odd string")
    prep = M.fit_preparation(train, ["n", "plain", "odd"])
    out = train.unionByName(spark.createDataFrame([(1.0, "new", "new")], train.schema))
    for stage in prep.stages():
        out = stage.transform(out)
    assert "_c0_1" in out.columns and "_c1v" in out.columns
    cells = [r["v"][1:] for r in out.select(vector_to_array("features").alias("v")).collect()]
    assert cells == [[1, 0, 0, 1], [0, 1, 1, 0], [1, 0, 0, 1], [0, 0, 0, 0]]
