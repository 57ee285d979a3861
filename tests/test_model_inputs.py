"""What the model queries write and read: no column and no pass that a later step has no use for."""

import pytest
from pyspark.sql import functions as F

from visitline.functions import ordered as O, probability as P
from visitline.operators import pairs as J, splits as T
from visitline.plans import models as plans
from visitline.plans.standins import FEATURES, SPEC

SF = "/root/testdata/sf0.001"


@pytest.fixture
def written(monkeypatch):
    """Frames that the plans and the splits materialize, by name."""
    from visitline.session import materialize

    frames = {}

    def record(df, name="stage"):
        frames[name] = materialize(df, name)
        return frames[name]

    monkeypatch.setattr(plans, "materialize", record)
    monkeypatch.setattr(T, "materialize", record)
    return frames


@pytest.fixture
def few_visits(spark, monkeypatch):
    """Visits of 40 subjects, one of them without any state, some values null."""
    rows = [
        (s, f"200{y}-0{1 + s % 9}-11", None if s == 7 else "FOP"[(s + y) % 3], 10 * s + y, None if y == 3 else 1.5 * s + y, 2.0 * s, "a", "bc"[s % 2], "m06")
        for s in range(40) for y in range(5)
    ]
    names = "subject long, visit_date string, state string, row_id long, spend double, balance double, priority string, segment string, visit_code string"
    frame = spark.createDataFrame(rows, names).withColumn("visit_date", F.to_date("visit_date"))
    monkeypatch.setattr(plans, "visits", lambda *_: frame)
    monkeypatch.setattr(plans, "bare_visits", lambda *_: frame.select("subject", "visit_date", "state", "row_id", "spend"))
    return frame


def test_pairs_are_written_without_unread_columns_from_visits_split_once(spark, written, few_visits):
    got = plans._pairs(spark, SF)
    assert set(written) >= {"tagged", "pairs"}
    assert got.columns == plans.PAIR_COLUMNS
    tagged = J.attach_split(few_visits, T.temporal_split(few_visits, "subject", "visit_date"), "subject")
    whole = J.transition_pairs(tagged, FEATURES, carry=["split"], **SPEC).select(plans.PAIR_COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_split_rows_hold_the_asked_columns_and_label_subjects_once(spark, written, few_visits):
    got = plans._split_rows(spark, SF, ["label", "spend", "segment"])
    assert got.columns == ["label", "spend", "segment", "split"]
    assert written["subject-labels"].count() == 40
    assert got.count() == few_visits.count()


def test_entropy_of_a_known_size_is_compiled_and_equal(spark):
    rows = spark.createDataFrame([([0.2, 0.3, 0.5],), ([1.0, 0.0, 0.0],), (None,), ([1 / 3, 1 / 3, 1 / 3],)], "prob array<double>")
    both = rows.where("prob IS NOT NULL").select(P.entropy(F.col("prob"), 3).alias("a"), P.entropy(F.col("prob")).alias("b"))
    assert [r["a"] for r in both.collect()] == pytest.approx([r["b"] for r in both.collect()], rel=1e-14)
    assert rows.where("prob IS NULL").select(P.entropy(F.col("prob"), 3).alias("a")).first()["a"] is None
    plan = rows.select(P.entropy(F.col("prob"), 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_medians_of_columns_with_nulls_nan_and_few_kept_rows(spark):
    rows = spark.createDataFrame([(float(i), None if i % 2 else float(-i)) for i in range(1001)] + [(float("nan"), 3.0)], "a double, b double")
    borders = {"a": (499.0, 501.0), "b": (-500.0, -490.0)}
    assert O.exact_medians(rows, borders) == {"a": 500.0, "b": -499.0}


@pytest.fixture
def flow_tables(monkeypatch):
    """Frames that the training flows materialize, by name."""
    from visitline.operators import experiments as X
    from visitline.session import materialize

    frames = {}

    def record(df, name="stage", *row_group):
        frames[name] = materialize(df, name, *row_group)
        return frames[name]

    monkeypatch.setattr(X, "materialize", record)
    return frames


def labelled(spark, n=400):
    rows = [(i // 4, i % 3 if i % 7 else (i // 3) % 3, float(i * 37 % 101), "xyz"[i % 3 - 1], None if i % 9 == 0 else float(i % 5), 1.0 + i % 2, "unread") for i in range(n)]
    return spark.createDataFrame(rows, "subject long, label int, a double, c string, b double, w double, note string")


def test_runs_are_written_by_number_and_a_small_forest_as_counts(spark, flow_tables):
    from visitline.operators import experiments as X, models as M
    from visitline.operators.metrics import multiclass_metrics

    frame = labelled(spark)
    models = {"logistic_regression": {"max_iter": 3}, "random_forest": {"n_estimators": 2, "max_depth": 2}}
    keys = ["seed", "feature_set", "model", "missing_indicators", "split"]
    got = X.seed_sweep(frame, {"s": ["a", "b", "c"]}, "subject", "label", models, (1,))
    assert got.columns[:5] == keys
    got = {tuple(r[k] for k in keys): r.asDict() for r in got.collect()}
    runs = flow_tables["runs"]
    assert set(runs.columns) == {"label", "prob", "split", "_n", "_run"}
    n = {r["_run"]: (r["rows"], r["n"]) for r in runs.groupBy("_run").agg(F.count("*").alias("rows"), F.sum("_n").alias("n")).collect()}
    assert {v[1] for v in n.values()} == {400} and [n[i][0] for i in (0, 2)] == [400, 400]
    assert all(n[i][0] <= 3 * 3 * 16 for i in (1, 3))  # splits, labels, pairs of leaves
    for run, (model, flag) in enumerate((m, f) for f in (False, True) for m in models):
        whole = runs.where(F.col("_run") == run).select("label", "prob", "split", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
        for r in multiclass_metrics(whole, "label", "prob", by=["split"]).collect():
            mine = got[1, "s", model, flag, r["split"]]
            for name, value in r.asDict().items():
                assert mine[name] == (pytest.approx(value, abs=1e-12) if isinstance(value, float) else value), name
    forest = M.fit_model(frame, ["a"], "label", "random_forest", {"n_estimators": 2, "max_depth": 2})
    assert M.gives_few_outputs(forest) and not M.gives_few_outputs(M.fit_model(frame, ["a"], "label", "logistic_regression", {"max_iter": 2}))


def test_folds_are_written_without_unread_columns_and_their_classes_counted_once(spark, flow_tables, monkeypatch):
    from visitline.operators import experiments as X, models as M

    given = []
    plain = M.fit_model
    monkeypatch.setattr(M, "fit_model", lambda train, *a, **k: given.append((train, k["class_rows"])) or plain(train, *a, **k))
    got = X.grouped_cross_validation(labelled(spark), ["a", "c"], "label", "logistic_regression", {"max_iter": 2}, n_splits=3, weight="w")
    assert got.columns[:2] == ["fold", "model"]
    assert [(r["fold"], r["model"]) for r in got.orderBy("fold").collect()] == [(i, "logistic_regression") for i in (1, 2, 3)]
    assert set(flow_tables["folds"].columns) == {"a", "c", "label", "w", "fold"}
    assert set(flow_tables["runs"].columns) == {"label", "prob", "_n", "_run"}
    for train, counts in given:
        assert sorted(map(tuple, counts)) == sorted(map(tuple, M.class_totals(train, "label", "w")))
