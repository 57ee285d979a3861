"""Queries: preparation statistics, model fitting, calibration, sweeps, importance and search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from visitline.functions import probability as P
from visitline.operators import catalog as C, experiments as X, models as M, pairs as J, selection as W, selective as V, splits as T, survival as E
from visitline.plans.cohorts import INTERVALS, index_frame
from visitline.plans.registry import query, rounded
from visitline.plans.standins import FEATURES, SCHEME, SPEC, VISITS_SQL, bare_visits, visits
from visitline.session import materialize, shared_folder
from visitline.sources import sinks as K

LR = {"logistic_regression": {"max_iter": 15}}
FOREST = {"random_forest": {"n_estimators": 5, "max_depth": 4}}
BOOST = {"hist_gradient_boosting": {"max_iter": 3, "max_leaf_nodes": 8, "learning_rate": 0.3}}


def _labelled(spark, sf):
    rows = visits(spark, sf)
    from visitline.functions.states import encode_state

    return rows.withColumn("label", encode_state(F.col("state"), SCHEME))


# What the queries on pairs read of them.
PAIR_COLUMNS = ["subject", "split", "label", "subject_weight", "source_state", "forecast_months", "spend", "segment"]


def _pairs(spark, sf):
    """Transition pairs of all subjects with their temporal split, written once.

    The visits with their split are written before they are paired, as pairs and their weights read them several times.
    """
    split = T.temporal_split(bare_visits(spark, sf), "subject", "visit_date")
    rows = visits(spark, sf).select("subject", "visit_date", "state", "row_id", *FEATURES)
    tagged = materialize(J.attach_split(rows, split, "subject"), "tagged")
    return materialize(J.transition_pairs(tagged, FEATURES, carry=["split"], **SPEC).select(PAIR_COLUMNS), "pairs")


def _index(spark, sf):
    split = T.temporal_split(bare_visits(spark, sf), "subject", "visit_date")
    return materialize(J.attach_split(index_frame(spark, sf), split, "subject"), "index")


def _split_rows(spark, sf, columns):
    """Columns of the labelled visits with a stratified subject split, written once before any fit."""
    rows = _labelled(spark, sf).select("subject", *columns)
    split = T.stratified_split(bare_visits(spark, sf), "subject", "state", seed=42).select("subject", "split")
    return materialize(J.attach_split(rows, split, "subject").drop("subject"), "split-rows")


def _json(df):
    return df.withColumn("confusion_matrix", F.to_json("confusion_matrix"))


# --- preparation -------------------------------------------------------------------------------


@query(
    "numeric_preparation",
    f"""WITH {VISITS_SQL}, l AS (SELECT 'spend' AS feature, spend AS v FROM visits UNION ALL SELECT 'balance', balance FROM visits),
    m AS (SELECT feature, quantile_cont(v, 0.5) AS median FROM l GROUP BY 1)
    SELECT feature, round(1 - count(v) / CAST(count(*) AS DOUBLE), 6) AS missing_rate, round(max(median), 6) AS median, round(avg(coalesce(v, median)), 6) AS mean,
      round(stddev_pop(coalesce(v, median)), 6) AS std FROM l JOIN m USING (feature) GROUP BY 1""",
)
def numeric_preparation(spark, sf):
    return rounded(M.numeric_statistics(visits(spark, sf), ["spend", "balance"]))


@query(
    "categorical_preparation",
    f"""WITH {VISITS_SQL}, l AS (SELECT 'priority' AS feature, priority AS level FROM visits UNION ALL SELECT 'segment', segment FROM visits),
    c AS (SELECT feature, level, count(*) AS n FROM l WHERE level IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, level) AS rn, count(*) OVER (PARTITION BY feature) AS k FROM c)
    SELECT feature, level AS mode, CAST(k AS BIGINT) AS levels FROM r WHERE rn = 1""",
)
def categorical_preparation(spark, sf):
    return M.category_modes(visits(spark, sf), ["priority", "segment"])


@query(
    "prepared_features",
    f"""WITH {VISITS_SQL}, s AS (SELECT avg(spend) AS m, stddev_pop(spend) AS d, quantile_cont(balance, 0.5) AS bm, avg((balance IS NULL)::INT) AS nb FROM visits),
    t AS (SELECT avg(coalesce(balance, bm)) AS b1, stddev_pop(coalesce(balance, bm)) AS b2 FROM visits, s)
    SELECT row_id, round((spend - m) / d, 6) AS z_spend, round((coalesce(balance, bm) - b1) / b2, 6) AS z_balance,
      round(((balance IS NULL)::INT - nb) / sqrt(nb * (1 - nb)), 6) AS z_flag, CAST((segment = 'BUILDING')::INT AS DOUBLE) AS is_building FROM visits, s, t""",
)
def prepared_features(spark, sf):
    """The four cells of the prepared vector that a reader can recompute."""
    from pyspark.ml.functions import vector_to_array

    rows = visits(spark, sf)
    prep = M.fit_preparation(rows, ["spend", "balance", "segment"], indicators=True)
    out = rows
    for stage in prep.stages():
        out = stage.transform(out)
    building = 3 + prep.categorical["segment"][1].index("BUILDING")
    cell = lambda i: F.get(vector_to_array("features"), F.lit(i))
    return rounded(
        out.select("row_id", cell(0).alias("z_spend"), cell(1).alias("z_balance"), cell(2).alias("z_flag"), cell(building).alias("is_building"))
    )


@query(
    "level_indices",
    f"""WITH {VISITS_SQL}, m AS (SELECT mode(priority ORDER BY priority) AS p, mode(segment ORDER BY segment) AS s FROM visits),
    a AS (SELECT row_id, coalesce(priority, m.p) AS p, coalesce(segment, m.s) AS s FROM visits, m),
    x AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS i FROM (SELECT DISTINCT priority AS level FROM visits WHERE priority IS NOT NULL)),
    y AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS i FROM (SELECT DISTINCT segment AS level FROM visits WHERE segment IS NOT NULL))
    SELECT row_id, CAST(x.i AS INT) AS priority_index, CAST(y.i AS INT) AS segment_index FROM a JOIN x ON a.p = x.level JOIN y ON a.s = y.level""",
)
def level_indices(spark, sf):
    """Which indicator of each categorical feature is set in the prepared vector."""
    from pyspark.ml.functions import vector_to_array

    rows = visits(spark, sf)
    prep = M.fit_preparation(rows, ["priority", "segment"])
    out = rows
    for stage in prep.stages():
        out = stage.transform(out)
    n, m = (len(prep.categorical[c][1]) for c in ("priority", "segment"))
    cells = vector_to_array("features")
    place = lambda start, size: (F.array_position(F.slice(cells, start + 1, size), 1.0) - 1).cast("int")
    return out.select("row_id", place(0, n).alias("priority_index"), place(n, m).alias("segment_index"))


# --- single models -----------------------------------------------------------------------------


def _fit_and_score(spark, sf, models, keep=("row_id", "label")):
    tagged = _split_rows(spark, sf, ["row_id", "label", *FEATURES])
    name, params = next(iter(models.items()))
    model = M.fit_model(tagged.where("split = 'train'"), FEATURES, "label", name, params)
    scored = M.score(model, tagged.where("split = 'test'"))
    return M.prediction_frame(scored, list(keep), SCHEME.states)


@query("logistic_regression_scores")
def logistic_regression_scores(spark, sf):
    return _fit_and_score(spark, sf, LR)


@query("random_forest_scores")
def random_forest_scores(spark, sf):
    return _fit_and_score(spark, sf, FOREST)


@query("gradient_boosting_scores")
def gradient_boosting_scores(spark, sf):
    return _fit_and_score(spark, sf, BOOST)


@query("perceptron_scores")
def perceptron_scores(spark, sf):
    return _fit_and_score(spark, sf, {"mlp_sklearn": {"hidden_layer_sizes": [8], "max_iter": 20}})


@query("voting_scores")
def voting_scores(spark, sf):
    rows = materialize(_labelled(spark, sf), "rows")
    early = rows.where(F.col("visit_date") < F.lit("1999-01-01").cast("date"))
    late = rows.where(F.col("visit_date") >= F.lit("1999-01-01").cast("date"))
    members = M.fit_voting(early, FEATURES, "label", ["logistic_regression", "random_forest"], {**LR, **FOREST})
    return M.prediction_frame(M.score(members, late, [2, 1]), ["row_id", "label"], SCHEME.states)


@query("saved_model_transfer")
def saved_model_transfer(spark, sf):
    """Train on baseline rows, save, load, score a later cohort that lacks one feature."""
    rows = _labelled(spark, sf)
    base = materialize(W.baseline_records(rows, "subject", "visit_code", "visit_date", "row_id"), "baseline")
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    K.save_model(M.fit_model(base, FEATURES, "label", "logistic_regression", LR["logistic_regression"]), path)
    later = W.latest_records(rows, "subject", "visit_date", "row_id").drop("priority")
    scored = M.score_frozen(K.load_model(path), later, M.frozen_schema(base, FEATURES), keep=["row_id", "label"])
    return M.prediction_frame(scored, ["row_id", "label"], SCHEME.states)


# --- flows -------------------------------------------------------------------------------------


@query("transition_aware_training")
def transition_aware_training(spark, sf):
    out = X.train_transition_aware(_pairs(spark, sf), ["spend", "segment"], {**LR, **FOREST})
    test = out["test_metrics"].withColumns({"ablation": F.lit("selected"), "split": F.lit("temporal_test")})
    return rounded(_json(out["results"].unionByName(test)))


@query("grouped_cross_validation")
def grouped_cross_validation(spark, sf):
    rows = _pairs(spark, sf).where("split <> 'temporal_test'")
    return rounded(_json(X.grouped_cross_validation(rows, ["spend", "source_state", "forecast_months"], "label", "logistic_regression",
                                                    LR["logistic_regression"], weight="subject_weight")))


def _transition_scores(spark, sf):
    pairs = _pairs(spark, sf)
    columns = ["spend", "segment", "source_state", "forecast_months"]
    model = M.fit_model(pairs.where("split = 'train'"), columns, "label", "random_forest", FOREST["random_forest"], weight="subject_weight")
    scored = M.score(model, pairs.where("split <> 'train'")).select("split", "label", "prob")
    return model, M.frozen_schema(pairs, columns), materialize(scored, "scored")


@query("calibration_comparison")
def calibration_comparison(spark, sf):
    _, _, scored = _transition_scores(spark, sf)
    return rounded(M.calibrate_and_select(scored, "label")[0])


@query("frozen_replay")
def frozen_replay(spark, sf):
    """Frozen model and validation threshold applied to matched later outcomes."""
    model, frozen, scored = _transition_scores(spark, sf)
    prob = F.col("prob")
    table = V.risk_coverage(scored, "label", prob, V.coverage_thresholds(scored.where("split = 'validation'"), prob, [1.0, 0.9, 0.8, 0.7]))
    threshold = V.select_threshold(table).first()["threshold"]
    rows = visits(spark, sf)
    before = rows.where(F.col("visit_date") < F.lit("2000-01-01").cast("date"))
    index = W.latest_records(before, "subject", "visit_date", "row_id").select(
        "subject", "spend", "segment", F.col("state").alias("source_state"), F.col("visit_date").alias("index_date")
    )
    later = _labelled(spark, sf).where(F.col("visit_date") >= F.lit("2000-01-01").cast("date")).select(
        "subject", "row_id", "visit_date", F.col("label").alias("outcome")
    )
    replay = later.join(index, "subject").withColumn("forecast_months", F.datediff("visit_date", "index_date") / F.lit(30.4375))
    aligned = M.score_frozen(model, replay, frozen, keep=["row_id", "outcome"])
    return rounded(_json(V.selective_replay(aligned, "outcome", prob, threshold)))


@query("landmark_models")
def landmark_models(spark, sf):
    out = X.train_landmark_models(_index(spark, sf), ["spend", "balance", "segment"], [24, 36], {**LR, **FOREST})
    results = out["results"].withColumn("split", F.lit("validation"))
    if out["test_metrics"] is None:
        return rounded(results)
    return rounded(results.unionByName(out["test_metrics"].withColumn("split", F.lit("temporal_test"))))


def _periods(spark, sf):
    index = _index(spark, sf)
    return index, materialize(E.person_periods(index, INTERVALS), "periods")


@query("discrete_time_model")
def discrete_time_model(spark, sf):
    out = X.train_discrete_time(_periods(spark, sf)[1], ["spend", "balance"], {**LR, **FOREST})
    results = out["results"].withColumn("split", F.lit("validation"))
    return rounded(results.unionByName(out["test_metrics"].withColumn("split", F.lit("temporal_test"))))


@query("model_cumulative_risk")
def model_cumulative_risk(spark, sf):
    index, periods = _periods(spark, sf)
    out = X.train_discrete_time(periods, ["spend", "balance"], LR)
    return rounded(X.predict_cumulative_risk(out["model"], index.where("split = 'temporal_test'"), INTERVALS))


@query("horizon_aware_model")
def horizon_aware_model(spark, sf):
    rows = visits(spark, sf)
    split = T.random_split(bare_visits(spark, sf), "subject")
    tagged = J.attach_split(rows, split, "subject")
    pairs = materialize(J.future_pairs(tagged, ["spend", "segment"], carry=["split"], **SPEC), "future-pairs")
    return rounded(_json(X.train_horizon_aware(pairs, ["spend", "segment"], LR)["metrics"]))


# --- sweeps ------------------------------------------------------------------------------------


def _sweep(spark, sf):
    rows = materialize(_labelled(spark, sf), "rows")
    return X.sweep_table(X.seed_sweep(rows, {"primary": ["spend", "balance", "segment"]}, "subject", "label", {**LR, **FOREST}, (42, 43)))


@query("seed_sweep")
def seed_sweep(spark, sf):
    return rounded(_json(_sweep(spark, sf)))


@query("seed_sweep_summary")
def seed_sweep_summary(spark, sf):
    return rounded(X.sweep_summary(_sweep(spark, sf), ["model", "missing_indicators"]))


_GROUPS = {"money": ["spend", "balance"], "profile": ["segment", "priority"], "absent": ["no_such"]}


@query("group_ablation")
def group_ablation(spark, sf):
    rows = materialize(_labelled(spark, sf), "rows")
    combos = {"all": ["money", "profile"], "money_only": ["money"], "profile_only": ["profile"], "none": ["absent"]}
    return rounded(_json(X.group_ablation(rows, combos, _GROUPS, "subject", "label", params=LR["logistic_regression"])))


@query("masked_robustness")
def masked_robustness(spark, sf):
    rows = materialize(_labelled(spark, sf), "rows")
    groups = {k: v for k, v in _GROUPS.items() if k != "absent"}
    return rounded(_json(X.masked_robustness(rows, FEATURES, groups, "subject", "label", params=LR["logistic_regression"], seeds=(42, 43))))


@query("feature_set_comparison")
def feature_set_comparison(spark, sf):
    rows = materialize(_labelled(spark, sf), "rows")
    compact = materialize(W.baseline_records(rows, "subject", None, "visit_date", "row_id"), "compact")
    full = materialize(W.baseline_records(rows, "subject", "visit_code", "visit_date", "row_id"), "full")
    return rounded(_json(X.compare_feature_sets(compact, full, ["spend"], FEATURES, "subject", "label", LR)))


def _importance(spark, sf):
    rows = materialize(_labelled(spark, sf), "rows")
    model = M.fit_model(rows, FEATURES, "label", "random_forest", FOREST["random_forest"])
    metrics = ["macro_f1", "f1_class_0", "f1_class_1", "f1_class_2"]
    return X.permutation_importance(model, rows, FEATURES, "label", "row_id", repeats=2, metrics=metrics)


@query("permutation_importance")
def permutation_importance(spark, sf):
    return rounded(_importance(spark, sf))


@query("permutation_importance_by_group")
def permutation_importance_by_group(spark, sf):
    group_of = {c: g for g, cols in _GROUPS.items() for c in cols}
    return rounded(X.importance_by_group(_importance(spark, sf).where("metric = 'macro_f1'"), group_of))


@query("suspicious_importance")
def suspicious_importance(spark, sf):
    table = _importance(spark, sf).where("metric = 'macro_f1'")
    return rounded(C.suspicious_top_features(table, forbidden=("spend", "state")))


@query("parameter_search")
def parameter_search(spark, sf):
    tagged = _split_rows(spark, sf, ["label", "spend", "segment"])
    grid = [{"C": c, "max_iter": 10} for c in (0.01, 1.0)]
    return rounded(X.tune_model(tagged.where("split = 'train'"), ["spend", "segment"], "label", "logistic_regression", grid,
                                validation=tagged.where("split = 'val'")))


@query("grouped_parameter_search")
def grouped_parameter_search(spark, sf):
    rows = materialize(_labelled(spark, sf), "rows")
    names = ["logistic_regression", "random_forest"]
    grids = {"logistic_regression": [{"C": 1.0, "max_iter": 10}], "random_forest": [{"n_estimators": 3, "max_depth": 3}]}
    return rounded(X.tune_many(rows, ["spend", "segment"], "label", names, candidates=grids, subject="subject", n_splits=3))


@query("model_error_cases")
def model_error_cases(spark, sf):
    rows = materialize(_labelled(spark, sf), "rows")
    model = M.fit_model(rows, FEATURES, "label", "random_forest", FOREST["random_forest"])
    return rounded(X.error_cases(M.score(model, rows), "label").select("row_id", "label", "predicted_label", "confidence"))


@query("model_uncertainty")
def model_uncertainty(spark, sf):
    from visitline.operators.metrics import uncertainty_measures, uncertainty_summary

    rows = materialize(_labelled(spark, sf).select("label", *FEATURES), "rows")
    model = M.fit_model(rows, FEATURES, "label", "random_forest", FOREST["random_forest"])
    return rounded(uncertainty_summary(uncertainty_measures(M.score(model, rows), F.col("prob"), len(SCHEME.states))))


@query("model_simplex_check")
def model_simplex_check(spark, sf):
    from visitline.operators.integrity import simplex_check

    rows = materialize(_labelled(spark, sf), "rows")
    model = M.fit_model(rows, FEATURES, "label", "logistic_regression", LR["logistic_regression"])
    scored = M.score(model, rows)
    return simplex_check(scored.select("prob"), F.col("prob"))
