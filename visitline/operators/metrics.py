"""Evaluation of predicted probabilities as DataFrame aggregations.

Predictions are reduced in one pass to a confusion table and, for ranking metrics, to counts per
distinct score. Every metric then works on those small or evenly split tables, for any number of
groups (splits, horizons, seeds, thresholds, bootstrap repetitions) at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from visitline.functions import probability as P
from visitline.functions.ordered import running_sums, with_value_bucket
from visitline.session import ship_package


def _ratio(num: Column, den: Column, default: float | None = None) -> Column:
    value = F.when(den > 0, num / den)
    return value if default is None else F.coalesce(value, F.lit(default))


def _add(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def confusion_cells(
    df: DataFrame, truth: str, predicted: Column, by: Sequence[str] = (), prob: Column | None = None,
    weight: Column | None = None, n_classes: int | None = None,
) -> DataFrame:
    """Row weight, log-loss and Brier sums per (group, truth, prediction)."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(*by, F.col(truth).cast("int").alias("_t"), predicted.cast("int").alias("_p"), w.alias("_w"),
                     *([prob.alias("_prob")] if prob is not None else []))
    aggs = [F.sum("_w").alias("n")]
    if prob is not None:
        own = F.get(F.col("_prob"), F.col("_t"))
        aggs += [
            F.sum(F.col("_w") * P.clipped_log_loss(own)).alias("ll"),
            F.sum(F.col("_w") * P.brier(F.col("_prob"), F.col("_t"), n_classes)).alias("br"),
        ]
    return rows.groupBy(*by, "_t", "_p").agg(*aggs)


def metrics_from_cells(cells: DataFrame, classes: Sequence[int], by: Sequence[str] = (), scored: bool = True) -> DataFrame:
    """All confusion-based metrics of each group from its confusion cells."""
    cell = lambda i, j: F.coalesce(
        F.sum(F.when((F.col("_t") == i) & (F.col("_p") == j), F.col("n"))), F.lit(0.0)
    )
    aggs = [cell(i, j).alias(f"c_{i}_{j}") for i in classes for j in classes]
    aggs.append(F.sum("n").alias("_n"))
    if scored:
        aggs += [F.sum("ll").alias("_ll"), F.sum("br").alias("_br")]
    wide = cells.groupBy(*by).agg(*aggs)
    hit = {k: F.col(f"c_{k}_{k}") for k in classes}
    support = {k: _add([F.col(f"c_{k}_{j}") for j in classes]) for k in classes}
    called = {k: _add([F.col(f"c_{i}_{k}") for i in classes]) for k in classes}
    n = F.col("_n")
    recall = {k: _ratio(hit[k], support[k]) for k in classes}
    f1 = {k: _ratio(F.lit(2.0) * hit[k], support[k] + called[k]) for k in classes}

    def mean_present(values):
        return _ratio(
            _add([F.coalesce(v, F.lit(0.0)) for v in values]), _add([v.isNotNull().cast("double") for v in values])
        )

    agreement = _add(list(hit.values())) / n
    chance = _add([support[k] * called[k] for k in classes]) / (n * n)
    out = {
        "n_rows": n,
        "accuracy": agreement,
        "balanced_accuracy": mean_present(list(recall.values())),
        "macro_f1": mean_present(list(f1.values())),
        "cohen_kappa": F.when(chance < 1, (agreement - chance) / (F.lit(1.0) - chance)),
    }
    if scored:
        out["log_loss"] = F.col("_ll") / n
        out["brier_score"] = F.col("_br") / n
    for k in classes:
        out[f"precision_class_{k}"] = _ratio(hit[k], called[k], 0.0)
        out[f"recall_class_{k}"] = F.coalesce(recall[k], F.lit(0.0))
        out[f"f1_class_{k}"] = F.coalesce(f1[k], F.lit(0.0))
    out["confusion_matrix"] = F.array(
        *[F.array(*[F.col(f"c_{i}_{j}").cast("bigint") for j in classes]) for i in classes]
    )
    return wide.select(*by, *[v.alias(k) for k, v in out.items()])


def _distinct_scores(
    df: DataFrame, truth: str, prob: Column, classes: Sequence[int], by: Sequence[str], weight: Column | None = None
) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight.cast("double")
    scored = df.select(*by, F.col(truth).cast("int").alias("_t"), w.alias("_w"), F.posexplode(prob).alias("class_id", "score"))
    return scored.groupBy(*by, "class_id", "score").agg(
        *[F.sum(F.when(F.col("_t") == k, F.col("_w")).otherwise(0.0)).alias(f"y{k}") for k in classes]
    )


def score_counts(
    df: DataFrame, truth: str, prob: Column, classes: Sequence[int], by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Weight of every true class per (group, scored class, distinct score), with its bucket."""
    counts = _distinct_scores(df, truth, prob, classes, by, weight)
    return with_value_bucket(counts, "score", [*by, "class_id"], rows=df.select(*by, F.posexplode(prob).alias("class_id", "score")))


def _part_wins(batches: Iterator[pa.RecordBatch], keys: Sequence[str], classes: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Totals and wins among the rows of each group in a batch; batches are numbered in order of all rows."""
    task = TaskContext.get().partitionId() << 32
    for number, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        y = {k: batch.column(f"y{k}").to_numpy(zero_copy_only=False) for k in classes}
        half = {}  # the weight below each row, a tie counted half
        for k, v in y.items():
            before = np.cumsum(v) - v
            half[k] = before - before[first][group] + v / 2.0
        sums = [np.add.reduceat(v, first) for v in y.values()]
        sums += [np.add.reduceat(y[a] * half[b], first) for a in classes for b in classes if a != b]
        taken = [batch.column(k).take(pa.array(first)) for k in keys]
        names = [*keys, "_part", *(f"y{k}" for k in classes), *(f"w_{a}_{b}" for a in classes for b in classes if a != b)]
        yield pa.RecordBatch.from_arrays([*taken, pa.array(np.full(len(first), task + number)), *map(pa.array, sums)], names=names)


def auc_ovr(
    df: DataFrame, truth: str, prob: Column, classes: Sequence[int], by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Exact one-vs-rest ROC-AUC with mid-rank ties, macro-averaged, per group.

    With exactly two true classes the score of class 1 separates the larger label from the smaller;
    an AUC that is not defined is null.
    """
    by = list(by)
    keys = [*by, "class_id"]
    ys = [f"y{k}" for k in classes]
    pairs = [(a, b) for a in classes for b in classes if a != b]
    # Distinct scores in order over all tasks: what a task holds is summed inside it, the tasks' totals give the rest.
    ordered = _distinct_scores(df, truth, prob, classes, by, weight).repartitionByRange(*keys, "score").sortWithinPartitions(*keys, "score")
    ship_package(df.sparkSession)
    fields = [f.dataType.simpleString() for f in ordered.select(*keys).schema]
    schema = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, fields)), "_part bigint", *(f"`{c}` double" for c in [*ys, *(f"w_{a}_{b}" for a, b in pairs)])])
    parts = ordered.mapInArrow(lambda batches: _part_wins(batches, keys, list(classes)), schema)
    lane = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({f"{y}_before": F.coalesce(F.sum(y).over(lane), F.lit(0.0)) for y in ys})
    wins = placed.groupBy(*keys).agg(
        *[F.sum(F.col(f"w_{a}_{b}") + F.col(f"y{a}") * F.col(f"y{b}_before")).alias(f"w_{a}_{b}") for a, b in pairs],
        *[F.sum(f"y{k}").alias(f"t{k}") for k in classes],
    )
    return auc_from_wins(wins, classes, by)


def auc_from_wins(wins: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Macro AUC per group from one row per scored class: ``w_a_b`` is the weight of pairs in which class a
    scores above class b (ties count half), ``t{k}`` the weight of class k."""
    pairs = [(a, b) for a in classes for b in classes if a != b]
    own = None
    for k in classes:
        rest = [b for b in classes if b != k]
        value = _ratio(_add([F.col(f"w_{k}_{b}") for b in rest]), F.col(f"t{k}") * _add([F.col(f"t{b}") for b in rest]))
        own = F.when(F.col("class_id") == k, value) if own is None else own.when(F.col("class_id") == k, value)
    present = [(F.col(f"t{k}") > 0).cast("int") for k in classes]
    two = None
    for a, b in pairs:
        if a > b:
            value = _ratio(F.col(f"w_{a}_{b}"), F.col(f"t{a}") * F.col(f"t{b}"))
            test = (F.col(f"t{a}") > 0) & (F.col(f"t{b}") > 0)
            two = F.when(test, value) if two is None else two.when(test, value)
    per_class = wins.select(*by, "class_id", own.alias("auc"), _add(present).alias("present"), two.alias("two"))
    k = len(classes)
    return per_class.groupBy(*by).agg(
        F.when(F.max("present") == 2, F.max(F.when(F.col("class_id") == 1, F.col("two"))))
        .when(F.count("auc") == k, F.avg("auc"))
        .alias("roc_auc_ovr")
    )


def multiclass_metrics(
    df: DataFrame,
    truth: str,
    prob: Column | str | None,
    classes: Sequence[int] = (0, 1, 2),
    by: Sequence[str] = (),
    predicted: Column | None = None,
    weight: Column | None = None,
    auc: bool = True,
) -> DataFrame:
    """The full multiclass report per group (one row when ``by`` is empty)."""
    by = list(by)
    p = F.col(prob) if isinstance(prob, str) else prob
    call = predicted if predicted is not None else P.predicted_class(p)
    base = metrics_from_cells(confusion_cells(df, truth, call, by, p, weight, len(classes)), classes, by, scored=p is not None)
    if p is None:
        return base.withColumns({c: F.lit(None).cast("double") for c in ("roc_auc_ovr", "log_loss", "brier_score")})
    if not auc:
        return base
    ranks = auc_ovr(df, truth, p, classes, by, weight)
    if by:
        return base.join(ranks, by, "left")
    return base.withColumn("roc_auc_ovr", ranks.scalar())


def binary_metrics(
    df: DataFrame, truth: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """The binary report per group: ranking, threshold and probability metrics."""
    by = list(by)
    rows = df.select(*by, F.col(truth).cast("int").alias("_y"), F.col(score).cast("double").alias("_s"))
    positive, called = F.col("_y") == 1, F.col("_s") >= F.lit(threshold)
    own = F.when(positive, F.col("_s")).otherwise(F.lit(1.0) - F.col("_s"))
    flat = rows.groupBy(*by).agg(
        F.count_if(positive & called).cast("double").alias("tp"),
        F.count_if(positive & ~called).cast("double").alias("fn"),
        F.count_if(~positive & called).cast("double").alias("fp"),
        F.count_if(~positive & ~called).cast("double").alias("tn"),
        F.avg(F.pow(F.col("_s") - F.col("_y"), F.lit(2.0))).alias("brier_score"),
        F.avg(P.clipped_log_loss(own)).alias("log_loss"),
    )
    counts = rows.groupBy(*by, F.col("_s").alias("score")).agg(
        F.sum(positive.cast("double")).alias("pos"),
        F.sum((~positive).cast("double")).alias("neg"),
    )
    counts = with_value_bucket(counts, "score", by, rows=rows.select(*by, F.col("_s").alias("score")))
    ranked = running_sums(counts, ["score"], ["pos", "neg"], by)
    pos_from = F.col("pos_total") - F.col("pos_before")
    all_from = pos_from + F.col("neg_total") - F.col("neg_before")
    ranks = ranked.groupBy(*by).agg(
        _ratio(
            F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)),
            F.max("pos_total") * F.max("neg_total"),
        ).alias("roc_auc"),
        F.when(
            (F.max("pos_total") > 0) & (F.max("neg_total") > 0),
            F.sum(F.col("pos") / F.col("pos_total") * (pos_from / all_from)),
        ).alias("pr_auc"),
    )
    if by:
        joined = flat.join(ranks, by, "left")
    else:
        joined = flat.withColumns({c: ranks.select(c).scalar() for c in ("roc_auc", "pr_auc")})
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    sens, spec = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    f1_pos, f1_neg = _ratio(2.0 * tp, 2.0 * tp + fp + fn), _ratio(2.0 * tn, 2.0 * tn + fp + fn)

    def mean_of(a, b):
        return (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / (
            a.isNotNull().cast("double") + b.isNotNull().cast("double")
        )

    return joined.select(
        *by,
        (tp + fn + fp + tn).cast("bigint").alias("n_rows"),
        "roc_auc",
        "pr_auc",
        ((tp + tn) / (tp + fn + fp + tn)).alias("accuracy"),
        mean_of(sens, spec).alias("balanced_accuracy"),
        mean_of(f1_pos, f1_neg).alias("macro_f1"),
        F.coalesce(sens, F.lit(0.0)).alias("sensitivity"),
        spec.alias("specificity"),
        _ratio(tp, tp + fp, 0.0).alias("ppv"),
        _ratio(tn, tn + fn).alias("npv"),
        "brier_score",
        "log_loss",
    )


def roc_points(df: DataFrame, truth: str, prob: Column, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest ROC point (score >= threshold) at every distinct score of every class."""
    by = list(by)
    ys = [f"y{k}" for k in classes]
    ranked = running_sums(score_counts(df, truth, prob, classes, by), ["score"], ys, [*by, "class_id"])
    above = {k: F.col(f"y{k}_total") - F.col(f"y{k}_before") for k in classes}
    tpr, fpr = None, None
    for k in classes:
        rest = [b for b in classes if b != k]
        t = _ratio(above[k], F.col(f"y{k}_total"))
        f = _ratio(_add([above[b] for b in rest]), _add([F.col(f"y{b}_total") for b in rest]))
        here = F.col("class_id") == k
        tpr = F.when(here, t) if tpr is None else tpr.when(here, t)
        fpr = F.when(here, f) if fpr is None else fpr.when(here, f)
    return ranked.select(*by, "class_id", F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))


def calibration_bins(df: DataFrame, truth: str, prob: Column, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """One-vs-rest calibration table: left-closed bins, the last one closed, empty ones left out."""
    rows = df.select(*by, F.col(truth).alias("_t"), F.posexplode(prob).alias("class_id", "_s"))
    binned = rows.withColumn("bin", F.least(F.floor(F.col("_s") * bins).cast("int"), F.lit(bins - 1)))
    return binned.groupBy(*by, "class_id", "bin").agg(
        F.count("*").alias("n"),
        F.avg("_s").alias("mean_predicted"),
        F.avg((F.col("_t") == F.col("class_id")).cast("double")).alias("observed_rate"),
    )


def right_closed_bin(score: Column, bins: int) -> Column:
    """Bin number 1..bins of ``(edge, next edge]``; a score of exactly 0 gets 0 (no bin)."""
    edges = F.array(*[F.lit(i * (1.0 / bins) if i < bins else 1.0) for i in range(bins)])
    return F.size(F.filter(edges, lambda e: e < score))


def expected_calibration_error(
    df: DataFrame, truth: str, prob: Column, by: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    by = list(by)
    rows = df.select(
        *by, P.confidence(prob).alias("_s"), (P.predicted_class(prob) == F.col(truth)).cast("double").alias("_hit")
    )
    return _calibration_gap(rows, by, bins, "ece")


def classwise_calibration_error(
    df: DataFrame, truth: str, prob: Column, by: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    rows = df.select(*by, F.col(truth).alias("_t"), F.posexplode(prob).alias("class_id", "_s"))
    rows = rows.withColumn("_hit", (F.col("_t") == F.col("class_id")).cast("double"))
    return _calibration_gap(rows, [*by, "class_id"], bins, "classwise_ece")


def _calibration_gap(rows: DataFrame, by: Sequence[str], bins: int, name: str) -> DataFrame:
    per_bin = rows.groupBy(*by, right_closed_bin(F.col("_s"), bins).alias("_bin")).agg(
        F.count("*").cast("double").alias("_n"), F.sum("_hit").alias("_h"), F.sum("_s").alias("_c")
    )
    gap = F.when(F.col("_bin") > 0, F.abs(F.col("_h") - F.col("_c"))).otherwise(0.0)
    return per_bin.groupBy(*by).agg((F.sum(gap) / F.sum("_n")).alias(name))


def uncertainty_measures(df: DataFrame, prob: Column, n_classes: int | None = None) -> DataFrame:
    return df.withColumns(
        {
            "max_probability": P.confidence(prob),
            "predictive_entropy": P.entropy(prob, n_classes),
            "probability_margin": P.margin(prob),
        }
    )


def uncertainty_summary(measured: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample standard deviation of each uncertainty measure, in long form."""
    names = ["max_probability", "predictive_entropy", "probability_margin"]
    wide = measured.groupBy(*by).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in names], *[F.stddev_samp(c).alias(f"std_{c}") for c in names]
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("measure"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std")) for c in names]
    )
    return wide.select(*by, F.inline(cells))
