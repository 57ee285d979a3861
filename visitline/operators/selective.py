"""Coverage thresholds, risk-coverage tables, scoped evaluation, model choice and error tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from visitline.functions import probability as P
from visitline.functions.ordered import exact_quantiles, seeded_hash
from visitline.functions.states import DEFAULT_SCHEME, StateScheme, error_groups
from visitline.operators.metrics import confusion_cells, metrics_from_cells, multiclass_metrics
from visitline.operators.selection import first_per_key


def coverage_thresholds(validation: DataFrame, prob: Column, coverages: Sequence[float]) -> DataFrame:
    """(target_coverage, threshold): the confidence quantile at 1 - coverage, exact."""
    names = [f"q{i}" for i in range(len(coverages))]
    wide = exact_quantiles(
        validation.select(P.confidence(prob).alias("c")), "c", [1.0 - c for c in coverages], names
    )
    cells = [
        F.struct(F.lit(float(c)).alias("target_coverage"), F.col(n).alias("threshold")) for c, n in zip(coverages, names)
    ]
    return wide.select(F.inline(F.array(*cells)))


def risk_coverage(
    df: DataFrame, truth: str, prob: Column, thresholds: DataFrame | Sequence[tuple[float, float]],
    classes: Sequence[int] = (0, 1, 2), by: Sequence[str] = ("split",),
) -> DataFrame:
    """Retained share and quality at every threshold.

    ``thresholds`` lists (target_coverage, threshold), one entry per coverage; a frame of
    :func:`coverage_thresholds` is fetched, which freezes the values. Each prediction is counted
    once under the number of thresholds it reaches; the table of a threshold is then the sum over
    all higher counts, so predictions are not repeated per threshold.
    """
    by = list(by)
    if isinstance(thresholds, DataFrame):
        thresholds = [(r["target_coverage"], r["threshold"]) for r in thresholds.collect()]
    frozen = sorted((float(t), float(c)) for c, t in thresholds)
    limits = F.array(*[F.lit(t) for t, _ in frozen])
    reached = F.size(F.filter(limits, lambda t: t <= P.confidence(prob)))
    rows = df.select(*by, F.col(truth).alias(truth), prob.alias("_prob"), reached.alias("_reached"))
    cells = confusion_cells(rows, truth, P.predicted_class(F.col("_prob")), [*by, "_reached"])
    # A row that reaches k thresholds is retained by the k smallest ones.
    levels = F.array(
        *[F.struct(F.lit(c).alias("target_coverage"), F.lit(t).alias("threshold")) for t, c in frozen]
    )
    retained = F.when(F.col("_reached") > 0, F.slice(levels, F.lit(1), F.col("_reached")))
    kept = cells.select("*", F.inline_outer(retained))
    totals = cells.groupBy(*by).agg(F.sum("n").alias("_all"))
    table = metrics_from_cells(
        kept.where(F.col("threshold").isNotNull()), classes, [*by, "target_coverage", "threshold"], scored=False
    )
    joined = table.join(totals, by) if by else table.withColumn("_all", totals.scalar())
    return joined.select(
        *by,
        "target_coverage",
        (F.col("n_rows") / F.col("_all")).alias("coverage"),
        "threshold",
        F.col("n_rows").cast("bigint").alias("n_retained"),
        "accuracy",
        "balanced_accuracy",
        "macro_f1",
        (F.lit(1.0) - F.col("accuracy")).alias("error_rate"),
    )


def select_threshold(table: DataFrame, split: str = "validation", minimum_coverage: float = 0.7) -> DataFrame:
    """Validation row with enough coverage and the best macro-F1, larger coverage first on ties."""
    eligible = table.where((F.col("split") == split) & (F.col("coverage") >= minimum_coverage))
    return eligible.orderBy(F.desc("macro_f1"), F.desc("coverage")).limit(1)


def selective_replay(
    df: DataFrame, truth: str, prob: Column, threshold: float, classes: Sequence[int] = (0, 1, 2)
) -> DataFrame:
    """Metrics of all rows and of the rows kept by a frozen threshold, with coverage."""
    rows = df.select(F.col(truth).alias(truth), prob.alias("_prob")).withColumn(
        "analysis",
        F.explode(
            F.when(P.confidence(F.col("_prob")) >= F.lit(float(threshold)), F.array(F.lit("all"), F.lit("selective")))
            .otherwise(F.array(F.lit("all")))
        ),
    )
    table = multiclass_metrics(rows, truth, "_prob", classes, ["analysis"])
    everything = table.where(F.col("analysis") == "all").select("n_rows").scalar()
    return table.withColumn("coverage", F.col("n_rows") / everything)


# Horizon bins of the external evaluation, in months; a bin is (low, high].
HORIZON_BINS = (
    ("0-12 months", 0.0, 12.0),
    ("12-24 months", 12.0, 24.0),
    ("24-36 months", 24.0, 36.0),
    (">36 months", 36.0, None),
)


def horizon_bin(months: Column, bins=HORIZON_BINS) -> Column:
    label = F.lit(None).cast("string")
    for name, low, high in reversed(bins):
        inside = months > F.lit(low) if high is None else (months > F.lit(low)) & (months <= F.lit(high))
        label = F.when(inside, F.lit(name)).otherwise(label)
    return label


def scoped_evaluation(
    df: DataFrame,
    truth: str,
    prob: str,
    subject: str,
    outcome_date: str,
    row_id: str,
    months: str = "forecast_months",
    min_rows: int = 20,
    classes: Sequence[int] = (0, 1, 2),
    predicted: Column | None = None,
) -> DataFrame:
    """Metrics of all rows, of first follow-ups and of every horizon bin.

    ``predicted`` are the labels called, where they are not the likeliest ones: label metrics follow them,
    AUC, log-loss and Brier score the probabilities. Scopes with fewer than ``min_rows`` rows keep their counts but get null metrics; empty bins are
    listed too.
    """
    rows = df.select(
        F.col(subject).alias("subject"), F.col(truth).alias("_truth"), F.col(prob).alias("_prob"),
        F.col(outcome_date).alias("_date"), F.col(row_id).alias("_row"), F.col(months).alias("_months"),
        (P.predicted_class(F.col(prob)) if predicted is None else predicted).cast("int").alias("_call"),
    )
    scope = lambda s, h: F.struct(F.lit(s).alias("scope"), h.alias("horizon"))
    overall = F.lit("overall")
    wide = rows.withColumn(
        "_scope", F.explode(F.array(scope("row_level", overall), scope("horizon", horizon_bin(F.col("_months")))))
    )
    first = first_per_key(rows, ["subject"], [F.col("_date").asc_nulls_last(), F.col("_row").asc()])
    tagged = wide.unionByName(first.withColumn("_scope", scope("first_follow_up", overall)))
    flat = tagged.select("subject", "_truth", "_prob", "_call", "_scope.*").where(F.col("horizon").isNotNull())
    keys = ["scope", "horizon"]
    subjects = flat.groupBy(*keys, "subject").agg(F.count("*").alias("k")).groupBy(*keys).agg(
        F.count("*").alias("n_subjects")
    )
    table = multiclass_metrics(flat, "_truth", "_prob", classes, keys, F.col("_call")).join(subjects, keys)
    listed = [("row_level", "overall"), ("first_follow_up", "overall"), *[("horizon", b[0]) for b in HORIZON_BINS]]
    frame = df.sparkSession.createDataFrame(listed, "scope string, horizon string")
    full = F.broadcast(frame).join(table, keys, "left")
    enough = F.coalesce(F.col("n_rows") >= min_rows, F.lit(False))
    metrics = [c for c in table.columns if c not in (*keys, "n_rows", "n_subjects")]
    return full.select(
        *keys,
        F.coalesce(F.col("n_rows"), F.lit(0.0)).cast("bigint").alias("n_rows"),
        F.coalesce("n_subjects", F.lit(0)).cast("bigint").alias("n_subjects"),
        enough.alias("stable_metrics_reported"),
        *[F.when(enough, F.col(c)).alias(c) for c in metrics],
    )


# --- choosing among results --------------------------------------------------------------------

# Complexity rank used to break ties towards the simpler model; others rank 99.
MODEL_COMPLEXITY = {
    "logistic_regression": 0,
    "hist_gradient_boosting": 1,
    "random_forest": 2,
    "lightgbm": 3,
    "xgboost": 4,
    "soft_voting": 5,
    "torch_mlp": 6,
    "ft_transformer": 7,
}


def complexity(model: Column, ranks: Mapping[str, int] = MODEL_COMPLEXITY) -> Column:
    from visitline.functions.states import literal_map

    return F.coalesce(F.try_element_at(literal_map(ranks), model), F.lit(99))


def select_model(results: DataFrame, ranks: Mapping[str, int] = MODEL_COMPLEXITY) -> DataFrame:
    return results.orderBy(
        F.desc("macro_f1"), F.asc("log_loss"), F.asc("brier_score"), complexity(F.col("model"), ranks)
    ).limit(1)


def select_landmark_models(results: DataFrame) -> DataFrame:
    order = [F.desc("pr_auc"), F.desc("balanced_accuracy"), F.asc("brier_score")]
    return first_per_key(results, ["horizon_months"], order)


def select_hazard_model(results: DataFrame) -> DataFrame:
    return results.orderBy(F.asc("log_loss"), F.desc("pr_auc")).limit(1)


def select_calibration(results: DataFrame) -> DataFrame:
    return results.orderBy(F.asc("log_loss"), F.asc("brier_score")).limit(1)


def select_within_tolerance(
    results: DataFrame, tolerance: float = 0.005, ranks: Mapping[str, int] = MODEL_COMPLEXITY
) -> DataFrame:
    """Simplest model whose macro-F1 is within ``tolerance`` of the best one."""
    best = results.agg(F.max("macro_f1")).scalar()
    close = results.where(F.col("macro_f1") >= best - F.lit(tolerance))
    return close.orderBy(
        complexity(F.col("model"), ranks), F.desc("macro_f1"), F.asc("log_loss"), F.asc("brier_score")
    ).limit(1)


def best_run(results: DataFrame, score: str = "val_macro_f1", order: str = "run") -> DataFrame:
    """Highest validation score; the earliest run wins ties."""
    return results.orderBy(F.desc_nulls_last(score), F.asc(order)).limit(1)


def best_per_ablation(results: DataFrame) -> DataFrame:
    return first_per_key(results, ["ablation"], [F.desc("macro_f1"), F.asc("log_loss")])


def top_k(df: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(value), *[F.asc(t) for t in ties]).limit(k)


def bounded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in seeded hash order; Spark keeps ``n`` rows per partition, then ``n`` overall."""
    return df.orderBy(seeded_hash(seed, F.col(key)), F.col(key)).limit(n)


# --- errors ------------------------------------------------------------------------------------


def error_group_counts(df: DataFrame, source: str, future: str, predicted: str, scheme: StateScheme = DEFAULT_SCHEME) -> DataFrame:
    groups = error_groups(F.col(source), F.col(future), F.col(predicted), scheme)
    wide = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in groups.items()])
    return wide.unpivot([], list(groups), "error_group", "rows")


def error_distribution(errors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Error count per value of each listed column, in long form."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return errors.select(F.inline(cells)).groupBy("field", "value").agg(F.count("*").alias("count"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count / mean / sample std / min / exact quartiles / max per column, in long form."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns])
    rows = df.select(F.inline(cells)).where(F.col("v").isNotNull())
    base = rows.groupBy("field").agg(
        F.count("*").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    return base.join(exact_quantiles(rows, "v", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], ["field"]), "field")


def confident_errors(errors: DataFrame, confidence: str, threshold: float, *ties: str) -> DataFrame:
    return errors.where(F.col(confidence) >= F.lit(threshold)).orderBy(F.desc(confidence), *[F.asc(t) for t in ties])


# --- repeated runs -----------------------------------------------------------------------------


def summarize_runs(results: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per metric; text cells that are no number are ignored."""
    value = lambda m: F.col(m).try_cast("double")
    return results.groupBy(*groups).agg(
        *[a for m in metrics for a in (F.avg(value(m)).alias(f"{m}_mean"), F.stddev_pop(value(m)).alias(f"{m}_std"))]
    )


def summarize_completed_runs(results: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """As :func:`summarize_runs`, leaving out runs without any metric."""
    return summarize_runs(results.dropna("all", subset=list(metrics)), groups, metrics)


def mask_drops(results: DataFrame, score: str = "macro_f1") -> DataFrame:
    """Absolute and relative score drop of every mask against the unmasked run of the same seed."""
    base = results.where(F.col("masked_group") == "none").select("seed", F.col(score).alias("_base"))
    drop = F.col("_base") - F.col(score)
    return results.join(base, "seed", "left").select(
        *results.columns,
        drop.alias("absolute_drop"),
        F.when(F.col("_base") != 0, drop / F.col("_base")).alias("relative_drop"),
    )


def mask_summary(results: DataFrame, metrics: Sequence[str], score: str = "macro_f1") -> DataFrame:
    """Per-mask metric summary joined with the mean drops."""
    drops = mask_drops(results, score).groupBy("masked_group").agg(
        F.avg("absolute_drop").alias("absolute_drop"), F.avg("relative_drop").alias("relative_drop")
    )
    return summarize_runs(results, ["masked_group"], metrics).join(drops, "masked_group", "left")


def group_importance(importance: DataFrame, group: str = "feature_group", value: str = "importance") -> DataFrame:
    return importance.groupBy(group).agg(F.sum(value).alias(value))


def running_rank(df: DataFrame, value: str, *ties: str, by: str) -> DataFrame:
    lane = Window.partitionBy(by).orderBy(F.desc(value), *[F.asc(t) for t in ties])
    return df.withColumn("rank", F.row_number().over(lane))
