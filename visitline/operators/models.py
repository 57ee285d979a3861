"""Feature preparation, classifiers, calibration and scoring on Spark ML.

A fitted model is an ordinary ``PipelineModel``: a SQL stage with the fitted preparation, a vector
assembler and a Spark ML classifier. It can be saved, loaded and applied without this package's
Python state.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import ceil, log2

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel, RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from visitline.functions import probability as P
from visitline.functions.ordered import exact_medians, median_sketch
from visitline.operators.metrics import classwise_calibration_error, expected_calibration_error, multiclass_metrics
from visitline.operators.selection import align_to_schema
from visitline.session import materialize


# --- preparation -------------------------------------------------------------------------------


SQL_LEVELS = 32  # a feature with at most so many levels gets its indicators as SQL cells
PLAIN_LEVEL = re.compile(r"[A-Za-z0-9 .,:;/&()+#-]*").fullmatch  # text that SQL and the transformer's statement leave alone


@dataclass(frozen=True)
class Preparation:
    """Statistics fitted on training rows only; one entry per feature, so schema-sized."""

    numeric: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # median, mean, std
    indicators: dict[str, tuple[float, float]] = field(default_factory=dict)  # mean, std of the null flag
    categorical: dict[str, tuple[str, list[str]]] = field(default_factory=dict)  # mode, sorted levels
    dropped: tuple[str, ...] = ()

    def subset(self, features: Sequence[str], indicators: bool = True) -> Preparation:
        """The same statistics for fewer features, or without the null flags."""
        keep = lambda d: {c: v for c, v in d.items() if c in features}
        return Preparation(
            keep(self.numeric), keep(self.indicators) if indicators else {}, keep(self.categorical),
            tuple(c for c in self.dropped if c in features),
        )

    def expressions(self) -> list[str]:
        out = []
        for name, (median, mean, std) in self.numeric.items():
            out.append(f"(coalesce(CAST(`{name}` AS DOUBLE), {median!r}D) - {mean!r}D) / {(std or 1.0)!r}D")
        for name, (mean, std) in self.indicators.items():
            out.append(f"(CAST(`{name}` IS NULL AS DOUBLE) - {mean!r}D) / {(std or 1.0)!r}D")
        return out

    def stages(self) -> list:
        """Numbers by SQL, levels by indicators, all in one vector.

        Levels are numbered in order of their text. A level that training hadn't has no indicator set. The indicators of a
        feature with few, plain levels are SQL cells too, which compile with the rest; others are an index and a
        sparse indicator, so a vector takes a few bytes per feature, however many levels there are.
        """
        cells = [f"{e} AS `_f{i}`" for i, e in enumerate(self.expressions())]
        inputs = [f"_f{i}" for i in range(len(cells))]
        sparse = {}
        for i, (c, (mode, levels)) in enumerate(self.categorical.items()):
            text = f"coalesce(CAST(`{c}` AS STRING), {_quoted(mode)})"
            if len(levels) <= SQL_LEVELS and all(map(PLAIN_LEVEL, levels)):
                cells += [f"CAST({text} = {_quoted(level)} AS DOUBLE) AS `_c{i}_{j}`" for j, level in enumerate(levels)]
                inputs += [f"_c{i}_{j}" for j in range(len(levels))]
            else:
                cells.append(f"{text} AS `_c{i}`")
                sparse[f"_c{i}"] = levels
                inputs.append(f"_c{i}v")
        out = [SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")]
        if sparse:
            names = list(sparse)
            places, hot = [f"{n}i" for n in names], [f"{n}v" for n in names]
            # one index per feature: an index over several features pads their lists of levels to one length
            indexers = [
                StringIndexerModel.from_labels(levels, inputCol=n, outputCol=p, handleInvalid="keep")
                for n, p, levels in zip(names, places, sparse.values())
            ]
            # the sizes come from the indices' metadata, so the encoder reads no row; the last one is the unseen level
            none = SparkSession.active().createDataFrame([], ", ".join(f"`{n}` string" for n in names))
            encoder = OneHotEncoder(inputCols=places, outputCols=hot, dropLast=True).fit(PipelineModel(indexers).transform(none))
            out += [*indexers, encoder]
        return [*out, VectorAssembler(inputCols=inputs, outputCol="features")]

    @property
    def width(self) -> int:
        return len(self.expressions()) + sum(len(levels) for _, levels in self.categorical.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feature_kinds(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical features by column type."""
    numeric = [f for f in features if isinstance(df.schema[f].dataType, T.NumericType)]
    return numeric, [f for f in features if f not in numeric]


def numeric_statistics(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Null share, true median, and mean / population deviation after imputing it, per feature.

    One scan takes moments and median borders of all features, a second the medians; imputed rows enter the
    moments by their number.
    """
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(numeric):
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v).alias(f"k{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}"), median_sketch(v).alias(f"s{i}")]
    row = train.agg(*aggs).first()
    held = {c: i for i, c in enumerate(numeric) if row[f"k{i}"]}
    medians = exact_medians(train, {c: row[f"s{i}"] for c, i in held.items()})
    out = []
    for c in numeric if row["n"] else ():
        if c not in held:
            out.append((c, 1.0, None, None, None))
            continue
        n, k, mean, var, median = row["n"], *(row[f"{x}{held[c]}"] for x in "kmv"), medians[c]
        filled = (mean * k + median * (n - k)) / n if k < n else mean
        a, b = mean - filled, median - filled
        squares = (var * k + a * a * k + b * b * (n - k)) / n if k < n else var
        out.append((c, (n - k) / n, median, filled, squares**0.5))
    return train.sparkSession.createDataFrame(out, "feature string, missing_rate double, median double, mean double, std double")


def category_counts(train: DataFrame, categorical: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in categorical])
    return train.select(F.inline(cells)).where(F.col("level").isNotNull()).groupBy("feature", "level").agg(
        F.count("*").alias("n")
    )


def category_modes(train: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Most frequent level per feature (smallest on ties) and the number of levels."""
    counts = category_counts(train, categorical)
    return counts.groupBy("feature").agg(
        F.min_by("level", F.struct((-F.col("n")).alias("n"), F.col("level").alias("l"))).alias("mode"),
        F.count("*").alias("levels"),
    )


def fit_preparation(train: DataFrame, features: Sequence[str], indicators: bool = False) -> Preparation:
    """Median imputation, optional null flags, z-scores and one-hot levels, from ``train`` only.

    Features without any training value are dropped. The levels are part of the model and come to the
    driver, as a model's weight per level does.
    """
    numeric, categorical = feature_kinds(train, features)
    stats = {r["feature"]: r for r in numeric_statistics(train, numeric).collect()} if numeric else {}
    kept = [c for c in numeric if stats[c]["median"] is not None]
    flags = {}
    if indicators:
        for c in kept:
            share = stats[c]["missing_rate"]
            if share > 0:
                flags[c] = (share, (share * (1.0 - share)) ** 0.5)
    levels: dict[str, tuple[str, list[str]]] = {}
    if categorical:
        found: dict[str, dict[str, int]] = {}
        for r in category_counts(train, categorical).collect():
            found.setdefault(r["feature"], {})[r["level"]] = r["n"]
        mode = {c: min(n, key=lambda level: (-n[level], level)) for c, n in found.items()}
        levels = {c: (mode[c], sorted(found[c])) for c in categorical if c in found}
    return Preparation(
        {c: (stats[c]["median"], stats[c]["mean"], stats[c]["std"]) for c in kept},
        flags,
        levels,
        tuple(c for c in features if c not in kept and c not in levels),
    )


# --- classifiers -------------------------------------------------------------------------------

BALANCED = ("logistic_regression", "random_forest")
MODEL_NAMES = ("logistic_regression", "random_forest", "hist_gradient_boosting", "mlp_sklearn")


def class_totals(train: DataFrame, label: str, weight: str | None = None, by: Sequence[str] = ()) -> list[Row]:
    """Rows and sample weight per class: one row per class (and value of ``by``)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return train.groupBy(*by, label).agg(F.count("*").alias("n"), F.sum(w).alias("w")).collect()


def summed_totals(rows: Sequence[Row], label: str) -> list[Row]:
    """Class totals of several parts together."""
    out: dict = {}
    for r in rows:
        n, w = out.get(r[label], (0, None))
        out[r[label]] = n + r["n"], w if r["w"] is None else r["w"] + (w or 0.0)
    return [Row(**{label: k, "n": n, "w": w}) for k, (n, w) in out.items()]


def class_weight(rows: Sequence[Row], label: str, weight: str | None, balanced: bool) -> tuple[Column, float]:
    """Row weight = sample weight x n / (classes x class rows), and its total."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    n = sum(r["n"] for r in rows)
    if not balanced:
        return w, float(sum(r["w"] for r in rows))
    factor, total = F.lit(1.0), 0.0
    for r in rows:
        share = n / (len(rows) * r["n"])
        factor = F.when(F.col(label) == r[label], F.lit(share)).otherwise(factor)
        total += share * r["w"]
    return w * factor, float(total)


def _estimator(name: str, params: Mapping, width: int, n_classes: int, total_weight: float, seed: int):
    if name == "logistic_regression":
        return LogisticRegression(
            labelCol="_label", weightCol="_weight", maxIter=params.get("max_iter", 2000), standardization=False,
            regParam=1.0 / (params.get("C", 1.0) * total_weight), family="binomial" if n_classes == 2 else "multinomial",
        )
    if name == "random_forest":
        return RandomForestClassifier(
            labelCol="_label", weightCol="_weight", numTrees=params.get("n_estimators", 300), seed=seed,
            maxDepth=params.get("max_depth") or 30, minInstancesPerNode=params.get("min_samples_leaf", 1),
        )
    if name == "hist_gradient_boosting":
        trees = GBTClassifier(
            labelCol="_label", weightCol="_weight", maxIter=params.get("max_iter", 200), seed=seed,
            stepSize=params.get("learning_rate", 0.05), minInstancesPerNode=params.get("min_samples_leaf", 20),
            maxDepth=max(1, ceil(log2(params.get("max_leaf_nodes", 31)))),
        )
        if n_classes == 2:
            return trees
        return OneVsRest(classifier=trees, labelCol="_label", weightCol="_weight", parallelism=n_classes)
    if name == "mlp_sklearn":
        hidden = list(params.get("hidden_layer_sizes", [64, 32]))
        return MultilayerPerceptronClassifier(
            labelCol="_label", layers=[width, *hidden, n_classes], maxIter=params.get("max_iter", 400), seed=seed
        )
    raise ValueError(f"Unsupported model: {name}")


# Settings of other libraries' models that Spark's have no counterpart for.
UNSUPPORTED = {"hist_gradient_boosting": ("l2_regularization", "early_stopping", "validation_fraction")}


def fit_model(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    name: str,
    params: Mapping | None = None,
    n_classes: int = 3,
    weight: str | None = None,
    indicators: bool = False,
    seed: int = 42,
    preparation: Preparation | None = None,
    class_rows: Sequence[Row] | None = None,
) -> PipelineModel:
    """Preparation and classifier fitted on ``train``; boosting and the MLP are not class-balanced.

    Forests with ``balanced_subsample`` are balanced over the whole table, not per tree. Settings without
    a counterpart, and weights of a model that takes none, raise a warning.

    ``preparation`` and ``class_rows`` (see :func:`class_totals`) may be shared by several fits on
    the same rows.
    """
    params = dict(params or {})
    for key in UNSUPPORTED.get(name, ()):
        if params.get(key):
            warnings.warn(f"{name}: {key} has no counterpart here and is ignored", stacklevel=2)
    if name == "mlp_sklearn" and weight is not None:
        warnings.warn("mlp_sklearn has no sample weights: the weight column is ignored", stacklevel=2)
    prep = preparation or fit_preparation(train, features, indicators)
    balanced = name in BALANCED and params.get("class_weight", "balanced") in ("balanced", "balanced_subsample")
    w, total = class_weight(class_rows or class_totals(train, label, weight), label, weight, balanced)
    ready = train.select(*features, F.col(label).cast("double").alias("_label"), w.alias("_weight"))
    stages = prep.stages()
    for stage in stages:
        ready = stage.transform(ready)
    model = _estimator(name, params, prep.width, n_classes, total, params.get("random_state", seed)).fit(
        ready.select("features", "_label", "_weight")
    )
    return PipelineModel(stages=[*stages, model])


def score(model: PipelineModel | Mapping[str, PipelineModel], df: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    """``df`` with a ``prob`` array; several models are combined by soft voting.

    Members are applied one after the other to the same rows, so no join is needed.
    """
    if not isinstance(model, Mapping):
        return _score_one(model, df, "prob")
    names = []
    out = df
    for i, member in enumerate(model.values()):
        out = _score_one(member, out, f"_p{i}")
        names.append(f"_p{i}")
    return out.withColumn("prob", P.soft_vote([F.col(n) for n in names], weights)).drop(*names)


FEW_NODES = 1024


def gives_few_outputs(model: PipelineModel) -> bool:
    """Whether rows are likely to share their probabilities: those of a small forest are sums over the leaves it has."""
    last = model.stages[-1]
    return isinstance(last, RandomForestClassificationModel) and last.totalNumNodes <= FEW_NODES


def _score_one(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    raw = model.transform(df)
    if isinstance(model.stages[-1], OneVsRestModel):
        # Boosted trees report half the log-odds of their class.
        odds = F.transform(vector_to_array("rawPrediction"), lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(m * F.lit(-2.0))))
        prob = P.renormalize(odds)
    else:
        prob = vector_to_array("probability")
    return raw.select(*df.columns, prob.alias(name))


def fit_voting(
    train: DataFrame, features: Sequence[str], label: str, members: Sequence[str], params: Mapping | None = None, **kwargs
) -> dict[str, PipelineModel]:
    """One fitted model per member, sharing one preparation."""
    if not members:
        raise ValueError("Soft voting needs at least one member.")
    prep = fit_preparation(train, features, kwargs.pop("indicators", False))
    rows = class_totals(train, label, kwargs.get("weight"))
    return {
        m: fit_model(train, features, label, m, (params or {}).get(m), preparation=prep, class_rows=rows, **kwargs)
        for m in members
    }


def prediction_frame(scored: DataFrame, keep: Sequence[str], states: Sequence[str]) -> DataFrame:
    """Kept columns, predicted label, one probability column per state, confidence."""
    prob = F.col("prob")
    return scored.select(
        *keep,
        P.predicted_class(prob).alias("predicted_label"),
        *[F.get(prob, F.lit(i)).alias(f"prob_{s}") for i, s in enumerate(states)],
        P.confidence(prob).alias("confidence"),
    )


def score_frozen(model, df: DataFrame, frozen: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Scores of another cohort after aligning it to the frozen feature schema; nothing is refitted."""
    return score(model, align_to_schema(df, frozen, keep))


def frozen_schema(df: DataFrame, features: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[f] for f in features])


# --- calibration -------------------------------------------------------------------------------

CALIBRATION_METHODS = ("uncalibrated", "sigmoid", "isotonic")


@dataclass(frozen=True)
class Calibration:
    """One fitted map per class; an empty ``maps`` leaves probabilities as they are."""

    method: str
    maps: tuple = ()

    def apply(self, df: DataFrame, prob: str = "prob") -> DataFrame:
        if not self.maps:
            return df
        if self.method == "sigmoid":
            cells = [
                F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.get(F.col(prob), F.lit(k)) * F.lit(a) + F.lit(b))))
                for k, (a, b) in enumerate(self.maps)
            ]
            return df.withColumn(prob, P.calibrated_or_base(F.array(*cells), F.col(prob)))
        out = df
        for k, model in enumerate(self.maps):
            out = model.transform(out.withColumn(f"_s{k}", F.get(F.col(prob), F.lit(k))))
        names = [f"_c{k}" for k in range(len(self.maps))]
        mapped = P.calibrated_or_base(F.array(*[F.col(n) for n in names]), F.col(prob))
        return out.withColumn(prob, mapped).select(*df.columns)


def fit_calibration(validation: DataFrame, label: str, method: str, n_classes: int = 3, prob: str = "prob") -> Calibration:
    """Per-class maps fitted on validation scores, collapsed to distinct (score, hit) counts first."""
    if method == "uncalibrated":
        return Calibration(method)
    if method not in CALIBRATION_METHODS:
        raise ValueError(f"Unsupported calibration method: {method}")
    maps = []
    long = validation.select(F.col(label).alias("_y"), F.posexplode(prob).alias("class_id", "score"))
    counts = long.groupBy("class_id", "score", (F.col("_y") == F.col("class_id")).cast("double").alias("hit")).agg(
        F.count("*").cast("double").alias("n")
    )
    for k in range(n_classes):
        own = counts.where(F.col("class_id") == k)
        if method == "sigmoid":
            ready = VectorAssembler(inputCols=["score"], outputCol="features").transform(own)
            n = own.agg(F.sum("n")).first()[0]
            model = LogisticRegression(
                labelCol="hit", weightCol="n", regParam=1.0 / n, standardization=False, maxIter=1000, family="binomial"
            ).fit(ready)
            maps.append((float(model.coefficients[0]), float(model.intercept)))
        else:
            averaged = own.groupBy("score").agg(
                (F.sum(F.col("hit") * F.col("n")) / F.sum("n")).alias("rate"), F.sum("n").alias("n")
            )
            maps.append(
                IsotonicRegression(
                    featuresCol="score", labelCol="rate", weightCol="n", predictionCol=f"_c{k}"
                ).fit(averaged).setFeaturesCol(f"_s{k}")
            )
    return Calibration(method, tuple(maps))


def calibrate_and_select(
    scored: DataFrame, label: str, methods: Sequence[str] = CALIBRATION_METHODS, split: str = "split", bins: int = 10,
    validation: str = "validation",
) -> tuple[DataFrame, dict[str, Calibration]]:
    """Metrics of every method on every split; maps see validation rows only.

    The row of the method with the best validation log-loss, then Brier score, is marked.
    """
    fitted = {m: fit_calibration(scored.where(F.col(split) == validation), label, m) for m in methods}
    union = None
    for m, c in fitted.items():
        part = c.apply(scored.select(split, label, "prob")).withColumn("method", F.lit(m))
        union = part if union is None else union.unionByName(part)
    union = materialize(union, "calibrated")
    keys = ["method", split]
    table = multiclass_metrics(union, label, "prob", by=keys).select(
        *keys, "n_rows", "log_loss", "brier_score", "macro_f1", "roc_auc_ovr"
    )
    table = table.join(expected_calibration_error(union, label, F.col("prob"), keys), keys)
    classwise = classwise_calibration_error(union, label, F.col("prob"), keys)
    table = table.join(classwise.groupBy(*keys).pivot("class_id", [0, 1, 2]).agg(F.first("classwise_ece")), keys)
    table = materialize(table.withColumnsRenamed({str(k): f"classwise_ece_{k}" for k in range(3)}), "calibration")
    best = (
        table.where(F.col(split) == validation)
        .agg(F.min_by("method", F.struct("log_loss", "brier_score")).alias("m"))
        .scalar()
    )
    return table.withColumn("selected_on_validation", F.col("method") == best), fitted
