"""Training flows: ablations, sweeps, transfer, risk models, importance and search.

Each flow fits models in a short driver loop over one prepared table and evaluates all of its runs
together, as one tagged frame of predictions, so evaluation is one job however many runs there are.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from visitline.functions import probability as P
from visitline.functions.skew import lookup_join
from visitline.operators import models as M, selective as V
from visitline.operators.metrics import binary_metrics, multiclass_metrics
from visitline.operators.selection import mask_columns
from visitline.operators.splits import grouped_folds, hash_ranked, stratified_split
from visitline.session import materialize
from visitline.operators.survival import cumulative_risk, landmark_cohort, risk_grid


NARROW_ROW_GROUP = 4 << 20  # bytes: every pass of a fit reads these tables, a few encoded bytes a row


def _tagged(parts: Sequence[tuple[DataFrame, Mapping]]) -> DataFrame:
    """Scored frames of several runs, labelled with the columns of their run, written once.

    Metrics read the table twice (confusion and ranks); without it every model would score its rows
    for each of them.
    """
    out = None
    for frame, tags in parts:
        part = frame.withColumns({k: F.lit(v) for k, v in tags.items()})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return materialize(out, "runs")


def _run_metrics(
    parts: Sequence[tuple[PipelineModel, DataFrame, Mapping]], label: str, by: Sequence[str], classes: Sequence[int] = (0, 1, 2)
) -> DataFrame:
    """The multiclass report of several runs, each a model, its scored frame (label, prob and further columns of ``by``) and tags.

    The runs go through the metrics by number, their tags come back to the report's rows. Where a model
    gives few different probabilities its equal rows are counted before they are written.
    """
    tags = list(dict.fromkeys(k for _, _, own in parts for k in own))
    keys = ["_run", *[c for c in by if c not in tags]]
    out = None
    for run, (model, frame, _) in enumerate(parts):
        frame = frame.select(label, "prob", *keys[1:])
        if M.gives_few_outputs(model):
            frame = frame.groupBy(*frame.columns).agg(F.count("*").alias("_n"))
        else:
            frame = frame.withColumn("_n", F.lit(1).cast("bigint"))
        frame = frame.withColumn("_run", F.lit(run))
        out = frame if out is None else out.unionByName(frame)
    report = multiclass_metrics(materialize(out, "runs"), label, "prob", classes, keys, weight=F.col("_n"))
    own = {}
    for tag in tags:
        for run, (_, _, values) in enumerate(parts):
            if tag in values:
                here, value = F.col("_run") == run, F.lit(values[tag])
                own[tag] = own[tag].when(here, value) if tag in own else F.when(here, value)
    return report.withColumns(own).select(*by, *[c for c in report.columns if c not in keys])


# --- transition-aware training -----------------------------------------------------------------


def ablation_features(features: Sequence[str], source: str = "source_state", horizon: str = "forecast_months") -> dict[str, list[str]]:
    base = list(features)
    return {
        "features_only": base,
        "features_plus_forecast": [*base, horizon],
        "features_plus_source": [*base, source],
        "features_plus_source_forecast": [*base, source, horizon],
    }


def train_transition_aware(
    pairs: DataFrame,
    features: Sequence[str],
    models: Mapping[str, Mapping],
    indicators: bool = True,
    seed: int = 42,
) -> dict:
    """Fit every ablation x model on train pairs and choose on validation; test is scored once.

    ``pairs`` needs split, label and subject_weight. Returns metric frames, the chosen model and its
    scored validation / temporal-test pairs.
    """
    train = pairs.where(F.col("split") == "train")
    validation = pairs.where(F.col("split") == "validation")
    ablations = ablation_features(features)
    fitted: dict[tuple[str, str], PipelineModel] = {}
    parts = []
    counts = M.class_totals(train, "label", "subject_weight")
    everything = M.fit_preparation(train, ablations["features_plus_source_forecast"], indicators)
    for ablation, columns in ablations.items():
        prep = everything.subset(columns)
        for name, params in models.items():
            model = M.fit_model(
                train, columns, "label", name, params, weight="subject_weight", seed=seed, preparation=prep,
                class_rows=counts,
            )
            fitted[ablation, name] = model
            parts.append((model, M.score(model, validation), {"ablation": ablation, "model": name}))
    results = materialize(_run_metrics(parts, "label", ["ablation", "model"]).withColumn("split", F.lit("validation")), "results")
    full = "features_plus_source_forecast"
    chosen = V.select_model(results.where(F.col("ablation") == full)).first()["model"]
    model = fitted[full, chosen]
    scored = M.score(model, pairs.where(F.col("split").isin("validation", "temporal_test")))
    test = multiclass_metrics(scored.where(F.col("split") == "temporal_test"), "label", "prob")
    return {
        "results": results,
        "best_by_ablation": V.best_per_ablation(results),
        "selected": chosen,
        "model": model,
        "features": ablations[full],
        "scored": scored,
        "test_metrics": test.withColumn("model", F.lit(chosen)),
    }


def grouped_cross_validation(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    name: str,
    params: Mapping | None = None,
    subject: str = "subject",
    n_splits: int = 5,
    weight: str | None = None,
    indicators: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Metrics per fold; a subject is never on both sides of a fold."""
    folds = grouped_folds(rows, subject, n_splits, seed).select(F.col("subject").alias(subject), "fold")
    read = list(dict.fromkeys([*features, label, *([weight] if weight else [])]))
    # A few columns look small enough on disk to be broadcast, whatever their rows: the hint keeps the join a distributed one.
    narrow = lookup_join(rows.select(*dict.fromkeys([subject, *read])), folds.hint("merge"), subject).select(*read, "fold")
    tagged = materialize(narrow, "folds", NARROW_ROW_GROUP)
    totals = M.class_totals(tagged, label, weight, by=["fold"])
    parts = []
    for fold in range(1, n_splits + 1):
        train, held = tagged.where(F.col("fold") != fold), tagged.where(F.col("fold") == fold)
        counts = M.summed_totals([r for r in totals if r["fold"] != fold], label)
        model = M.fit_model(
            train, features, label, name, params, weight=weight, indicators=indicators, seed=seed, class_rows=counts
        )
        parts.append((model, M.score(model, held), {"fold": fold, "model": name}))
    return _run_metrics(parts, label, ["fold", "model"])


# --- risk models -------------------------------------------------------------------------------


def train_landmark_models(
    index: DataFrame, features: Sequence[str], horizons: Sequence[int], models: Mapping[str, Mapping],
    tolerance: float = 6, indicators: bool = True, seed: int = 42,
) -> dict:
    """Binary risk model per horizon, chosen on validation and scored once on the temporal test.

    ``index`` carries ``split``. Horizons whose train or validation rows hold one class are skipped;
    a one-class test is not scored.
    """
    fitted, parts = {}, []
    cohorts = {h: landmark_cohort(index, h, tolerance) for h in horizons}
    for h, cohort in cohorts.items():
        classes = {
            r["split"]: r["k"] for r in cohort.groupBy("split").agg(F.count_distinct("label").alias("k")).collect()
        }
        if classes.get("train", 0) < 2 or classes.get("validation", 0) < 2:
            continue
        train = cohort.where(F.col("split") == "train")
        prep = M.fit_preparation(train, features, indicators)
        counts = M.class_totals(train, "label")
        for name, params in models.items():
            model = M.fit_model(
                train, features, "label", name, params, n_classes=2, seed=seed, preparation=prep, class_rows=counts
            )
            fitted[h, name] = (model, classes.get("temporal_test", 0) >= 2)
            scored = M.score(model, cohort.where(F.col("split") == "validation"))
            parts.append((_positive(scored), {"horizon_months": h, "model": name}))
    results = binary_metrics(_tagged(parts), "label", "score", by=["horizon_months", "model"])
    best = {r["horizon_months"]: r["model"] for r in V.select_landmark_models(results).collect()}
    tests = []
    for h, name in best.items():
        model, usable = fitted[h, name]
        if usable:
            scored = M.score(model, cohorts[h].where(F.col("split") == "temporal_test"))
            tests.append((_positive(scored), {"horizon_months": h, "model": name}))
    test = binary_metrics(_tagged(tests), "label", "score", by=["horizon_months", "model"]) if tests else None
    return {"results": results, "selected": best, "test_metrics": test, "models": {h: fitted[h, n][0] for h, n in best.items()}}


def _positive(scored: DataFrame) -> DataFrame:
    return scored.select("label", F.get("prob", F.lit(1)).alias("score"))


def train_discrete_time(
    periods: DataFrame, features: Sequence[str], models: Mapping[str, Mapping], indicators: bool = True, seed: int = 42
) -> dict:
    """Hazard model on person-period rows, chosen by validation log-loss then PR-AUC."""
    columns = [*features, "interval_index", "elapsed_months"]
    train = periods.where(F.col("split") == "train")
    prep = M.fit_preparation(train, columns, indicators)
    fitted, parts = {}, []
    for name, params in models.items():
        fitted[name] = M.fit_model(train, columns, "label", name, params, n_classes=2, seed=seed, preparation=prep)
        scored = M.score(fitted[name], periods.where(F.col("split") == "validation"))
        parts.append((_positive(scored), {"model": name}))
    results = binary_metrics(_tagged(parts), "label", "score", by=["model"])
    chosen = V.select_hazard_model(results).first()["model"]
    test = _positive(M.score(fitted[chosen], periods.where(F.col("split") == "temporal_test")))
    return {
        "results": results,
        "selected": chosen,
        "model": fitted[chosen],
        "test_metrics": binary_metrics(test, "label", "score").withColumn("model", F.lit(chosen)),
    }


def predict_cumulative_risk(model: PipelineModel, index: DataFrame, interval_ends: Sequence[int]) -> DataFrame:
    """Hazard and cumulative risk of every index visit at every interval end."""
    scored = M.score(model, risk_grid(index, interval_ends))
    hazard = scored.select("subject", "interval_index", "elapsed_months", F.get("prob", F.lit(1)).alias("hazard"))
    return cumulative_risk(hazard)


# --- horizon-aware and transfer ----------------------------------------------------------------


def train_horizon_aware(
    pairs: DataFrame, features: Sequence[str], models: Mapping[str, Mapping], indicators: bool = True, seed: int = 42,
    train: str = "train",
) -> dict:
    """Source features and months ahead -> later state; metrics overall and per horizon bin."""
    columns = [*features, "forecast_months"]
    rows = pairs.where(F.col("split") == train)
    prep = M.fit_preparation(rows, columns, indicators)
    fitted, parts = {}, []
    for name, params in models.items():
        fitted[name] = M.fit_model(rows, columns, "label", name, params, seed=seed, preparation=prep)
        scored = M.score(fitted[name], pairs.where(F.col("split") != train))
        scopes = F.array_compact(F.array(F.lit("overall"), V.horizon_bin(F.col("forecast_months"))))
        parts.append((fitted[name], scored.select("label", "prob", "split", F.explode(scopes).alias("horizon")), {"model": name}))
    metrics = _run_metrics(parts, "label", ["model", "split", "horizon"])
    return {"metrics": metrics, "models": fitted, "features": columns}


# --- sweeps ------------------------------------------------------------------------------------

SUMMARY_METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "roc_auc_ovr", "log_loss", "brier_score")


def _split_rows(rows: DataFrame, subject: str, label: str, seed: int) -> DataFrame:
    assigned = stratified_split(rows, subject, label, seed).select(F.col("subject").alias(subject), "split")
    return lookup_join(rows, assigned, subject)


def seed_sweep(
    rows: DataFrame,
    feature_sets: Mapping[str, Sequence[str]],
    subject: str,
    label: str,
    models: Mapping[str, Mapping],
    seeds: Sequence[int] = (42,),
    indicator_variants: Sequence[bool] = (False, True),
    splits_from: DataFrame | None = None,
) -> DataFrame:
    """Metrics per seed, feature set, model, indicator variant and split (train, val, test).

    One stratified subject split per seed is shared by every run. ``splits_from`` lets several
    tables use the split of one of them.
    """
    parts, sizes = [], None
    for seed in seeds:
        assigned = stratified_split(
            splits_from if splits_from is not None else rows, subject, label, seed
        ).select(F.col("subject").alias(subject), "split")
        tagged = lookup_join(rows, assigned, subject)
        tagged = materialize(tagged, "split-rows")
        # every run of a seed scores the same rows
        own = tagged.groupBy("split", subject).agg(F.count("*").alias("n")).groupBy("split").agg(
            F.count("*").alias("n_subjects"), F.sum("n").alias("n_visits")
        ).withColumn("seed", F.lit(seed))
        sizes = own if sizes is None else sizes.unionByName(own)
        train = tagged.where(F.col("split") == "train")
        counts = M.class_totals(train, label)
        for set_name, features in feature_sets.items():
            flagged = M.fit_preparation(train, features, any(indicator_variants))
            for flag in indicator_variants:
                prep = flagged if flag else flagged.subset(features, indicators=False)
                for name, params in models.items():
                    model = M.fit_model(
                        train, features, label, name, params, seed=seed, preparation=prep, class_rows=counts
                    )
                    tags = {"seed": seed, "feature_set": set_name, "model": name, "missing_indicators": flag}
                    parts.append((model, M.score(model, tagged), tags))
    keys = ["seed", "feature_set", "model", "missing_indicators", "split"]
    table = _run_metrics(parts, label, keys).join(sizes, ["seed", "split"])
    return table.select(*keys, *[c for c in table.columns if c not in keys])


def sweep_table(sweep: DataFrame) -> DataFrame:
    """Test metrics of every run with its train and validation macro-F1 alongside."""
    keys = ["seed", "feature_set", "model", "missing_indicators"]
    sweep = materialize(sweep, "sweep")  # a row per run and split, read three times
    side = lambda s: sweep.where(F.col("split") == s).select(*keys, F.col("macro_f1").alias(f"{s}_macro_f1"))
    return sweep.where(F.col("split") == "test").drop("split").join(side("train"), keys).join(side("val"), keys)


def sweep_summary(table: DataFrame, groups: Sequence[str]) -> DataFrame:
    return V.summarize_runs(table, groups, [*SUMMARY_METRICS, "train_macro_f1", "val_macro_f1"])


def group_ablation(
    rows: DataFrame, combinations: Mapping[str, Sequence[str]], groups: Mapping[str, Sequence[str]], subject: str, label: str,
    name: str = "logistic_regression", params: Mapping | None = None, seeds: Sequence[int] = (42,),
) -> DataFrame:
    """Sweep over unions of feature groups; a combination without columns yields no rows."""
    sets = {}
    for combo, members in combinations.items():
        columns = list(dict.fromkeys(c for g in members for c in groups.get(g, []) if c in rows.columns))
        if columns:
            sets[combo] = columns
    sweep = seed_sweep(rows, sets, subject, label, {name: params or {}}, seeds, (True,))
    return sweep_table(sweep).withColumnRenamed("feature_set", "group")


def masked_robustness(
    rows: DataFrame, features: Sequence[str], groups: Mapping[str, Sequence[str]], subject: str, label: str,
    name: str = "logistic_regression", params: Mapping | None = None, seeds: Sequence[int] = (42,),
) -> DataFrame:
    """Fit once per seed, null one feature group of the test rows at a time, report the drops."""
    parts = []
    for seed in seeds:
        tagged = materialize(_split_rows(rows, subject, label, seed), "split-rows")
        model = M.fit_model(
            tagged.where(F.col("split") == "train"), features, label, name, params, indicators=True, seed=seed
        )
        test = tagged.where(F.col("split") == "test")
        for group, columns in {"none": [], **groups}.items():
            masked = mask_columns(test, [c for c in columns if c in features]) if columns else test
            parts.append((model, M.score(model, masked), {"seed": seed, "masked_group": group}))
    metrics = materialize(_run_metrics(parts, label, ["seed", "masked_group"]), "metrics")
    return V.mask_drops(metrics)


def compare_feature_sets(
    compact: DataFrame, full: DataFrame, compact_features: Sequence[str], full_features: Sequence[str], subject: str, label: str,
    models: Mapping[str, Mapping], seeds: Sequence[int] = (42,),
) -> DataFrame:
    """Two feature sets on the subjects both cohorts label alike, with the same splits."""
    from visitline.operators.drift import concordant_subjects

    same = concordant_subjects(compact, full, subject, label).select(subject)
    a, b = compact.join(same, subject, "left_semi"), full.join(same, subject, "left_semi")
    left = seed_sweep(a, {"compact": compact_features}, subject, label, models, seeds, (True,), splits_from=b)
    right = seed_sweep(b, {"full": full_features}, subject, label, models, seeds, (True,))
    return sweep_table(left).unionByName(sweep_table(right))


# --- importance --------------------------------------------------------------------------------


def permutation_importance(
    model, rows: DataFrame, features: Sequence[str], label: str, row_id: str, repeats: int = 5, seed: int = 42,
    metrics: Sequence[str] = ("macro_f1",),
) -> DataFrame:
    """Metric drop per feature when its values are permuted over all rows.

    Rows get a place in seeded hash order; a repeat maps place ``i`` to ``a * i + b mod n`` with
    ``a`` prime to ``n``, which is a permutation. Values travel by one join on the place per repeat, which
    serves all features; exchanging one feature at a time afterwards moves nothing.
    """
    placed = hash_ranked(rows.select(F.col(row_id).alias("subject"), *features, label), seed)
    n = int(rows.count())
    rng = random.Random(seed)
    runs = []
    for repeat in range(repeats):
        a = rng.randrange(1, max(n, 2))
        while math.gcd(a, n) != 1:
            a = rng.randrange(1, max(n, 2))
        runs.append((repeat, a, rng.randrange(n)))
    cells = F.array(
        *[F.struct(F.lit(r).alias("repeat"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for r, a, b in runs]
    )
    donors = placed.select(F.col("position").alias("from"), *[F.col(f).alias(f"_d_{f}") for f in features])
    wide = (
        placed.withColumn("run", F.explode(cells))
        # Decimal arithmetic: place times multiplier can pass 64 bits.
        .withColumn(
            "from",
            F.pmod(
                F.col("position").cast("decimal(19,0)") * F.col("run.a").cast("decimal(19,0)") + F.col("run.b").cast("decimal(19,0)"),
                F.lit(n).cast("decimal(19,0)"),
            ).cast("bigint"),
        )
        .join(donors, "from")
        .withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
        .select(
            label, "feature", "run.repeat",
            *[F.when(F.col("feature") == f, F.col(f"_d_{f}")).otherwise(F.col(f)).alias(f) for f in features],
        )
    )
    auc = "roc_auc_ovr" in metrics
    permuted = multiclass_metrics(M.score(model, wide), label, "prob", by=["feature", "repeat"], auc=auc)
    base = multiclass_metrics(M.score(model, rows), label, "prob", auc=auc)
    drops = permuted.select(
        "feature", "repeat", *[(base.select(m).scalar() - F.col(m)).alias(m) for m in metrics]
    )
    long = drops.unpivot(["feature", "repeat"], list(metrics), "metric", "drop")
    return long.groupBy("metric", "feature").agg(
        F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("importance_std")
    )


def importance_by_group(importance: DataFrame, group_of: Mapping[str, str]) -> DataFrame:
    from visitline.functions.states import literal_map

    tagged = importance.withColumn("feature_group", F.try_element_at(literal_map(dict(group_of)), F.col("feature")))
    return V.group_importance(tagged)


# --- search ------------------------------------------------------------------------------------

# Ranges searched per model (low, high, scale) or choices.
SEARCH_SPACES = {
    "logistic_regression": {"C": (1e-3, 1e2, "log")},
    "random_forest": {
        "n_estimators": (100, 900, 50),
        "max_depth": [None, 6, 10, 16, 24],
        "min_samples_leaf": (1, 20, 1),
    },
    "hist_gradient_boosting": {
        "max_iter": (100, 800, 50),
        "learning_rate": (0.01, 0.3, "log"),
        "max_leaf_nodes": (8, 128, "log_int"),
        "min_samples_leaf": (5, 100, 1),
    },
}
MAXIMIZED = ("macro_f1", "roc_auc_ovr")


def sample_params(space: Mapping, rng: random.Random) -> dict:
    out = {}
    for key, spec in space.items():
        if isinstance(spec, list):
            out[key] = rng.choice(spec)
        elif spec[2] == "log":
            out[key] = math.exp(rng.uniform(math.log(spec[0]), math.log(spec[1])))
        elif spec[2] == "log_int":
            out[key] = round(math.exp(rng.uniform(math.log(spec[0]), math.log(spec[1]))))
        else:
            out[key] = rng.randrange(spec[0], spec[1] + 1, spec[2])
    return out


def tune_model(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    name: str,
    candidates: Sequence[Mapping] | None = None,
    validation: DataFrame | None = None,
    subject: str | None = None,
    metric: str = "macro_f1",
    n_trials: int = 20,
    n_splits: int = 5,
    weight: str | None = None,
    n_classes: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Score parameter sets on held-out rows and rank them.

    With ``validation`` every candidate is scored there; otherwise subject-grouped folds of
    ``train`` are used. A test split is not an argument, so it cannot be looked at. Without
    ``candidates`` a seeded sample of the model's search space is drawn.
    """
    if metric not in ("macro_f1", "log_loss", "roc_auc_ovr"):
        raise ValueError(f"Unsupported tuning metric: {metric}")
    if candidates is None:
        if name not in SEARCH_SPACES:
            raise ValueError(f"{name} needs candidates; a search space is known for {', '.join(sorted(SEARCH_SPACES))}")
        rng = random.Random(seed)
        candidates = [sample_params(SEARCH_SPACES[name], rng) for _ in range(n_trials)]
    if validation is None and subject is None:
        raise ValueError("Give validation rows, or a subject column for grouped folds.")
    sides = [(train, validation, 0)]
    if validation is None:
        folds = grouped_folds(train, subject, n_splits, seed).select(F.col("subject").alias(subject), "fold")
        tagged = materialize(lookup_join(train, folds, subject), "folds")
        sides = [(tagged.where(F.col("fold") != k), tagged.where(F.col("fold") == k), k) for k in range(1, n_splits + 1)]
    # Medians, scales and levels come from the rows a model is fitted on, never from those it is scored on.
    shared = {fold: (M.fit_preparation(fit_rows, features, True), M.class_totals(fit_rows, label, weight)) for fit_rows, _, fold in sides}
    parts = []
    for trial, params in enumerate(candidates):
        for fit_rows, held, fold in sides:
            prep, counts = shared[fold]
            model = M.fit_model(
                fit_rows, features, label, name, params, n_classes=n_classes, weight=weight, seed=seed, preparation=prep, class_rows=counts
            )
            parts.append((model, M.score(model, held), {"trial": trial, "params": repr(dict(params)), "fold": fold}))
    table = _run_metrics(parts, label, ["trial", "params", "fold"], tuple(range(n_classes)))
    means = table.groupBy("trial", "params").agg(F.avg(metric).alias("value"))
    order = F.desc("value") if metric in MAXIMIZED else F.asc("value")
    return means.select(F.lit(name).alias("model"), "trial", "params", F.lit(metric).alias("metric"), "value").orderBy(order, "trial")


def tune_many(train: DataFrame, features: Sequence[str], label: str, names: Sequence[str], **kwargs) -> DataFrame:
    """Best value per model, best model first."""
    out = None
    candidates = kwargs.pop("candidates", {})
    metric = kwargs.get("metric", "macro_f1")
    for name in names:
        table = tune_model(train, features, label, name, candidates=candidates.get(name), **kwargs)
        best = table.limit(1).select("model", "metric", F.col("value").alias("best_value"), F.col("params").alias("best_params"))
        best = best.withColumn("n_trials", F.lit(len(candidates.get(name) or []) or kwargs.get("n_trials", 20)))
        out = best if out is None else out.unionByName(best)
    return out.orderBy(F.desc("best_value") if metric in MAXIMIZED else F.asc("best_value"))


def error_cases(scored: DataFrame, label: str) -> DataFrame:
    """Misclassified rows, most confident first."""
    call = P.predicted_class(F.col("prob"))
    wrong = scored.withColumns({"predicted_label": call, "confidence": P.confidence(F.col("prob"))})
    return wrong.where(F.col(label) != F.col("predicted_label")).orderBy(F.desc("confidence"))
