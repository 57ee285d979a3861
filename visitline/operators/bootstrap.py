"""Subject block bootstrap.

A draw is a (repetition, draw number) pair whose seeded hash picks a subject, so the same seed always
gives the same resamples. The draws of a subject over all repetitions travel together, as one list per
subject: rows meet it in one join, and equal predictions are summed into one array of weights over the
repetitions before anything is shuffled. Resampled rows are never materialised.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from visitline.functions import probability as P
from visitline.functions.digests import seeded_hashes
from visitline.functions.skew import MIN_HOT_ROWS, lookup_join, salted_join
from visitline.operators.metrics import auc_from_wins, metrics_from_cells, multiclass_metrics
from visitline.operators.splits import hash_ranked
from visitline.session import materialize, release, ship_package

METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "roc_auc_ovr", "log_loss", "brier_score")
ROWS_TOGETHER = 64  # predictions of a subject in one list
DRAWS_TOGETHER = 1 << 15  # draws that a task makes at a time, if its batch has no more rows
HELD_WEIGHTS = 1 << 19  # weights over repetitions that one task holds before it hands them on

_PARTIAL = (
    "kind string, truth int, called int, prob array<double>, weights array<double>, losses array<double>, briers array<double>"
)


def subject_places(df: DataFrame, subject: str, seed: int) -> DataFrame:
    """(subject, position, size): every subject's place in seeded hash order."""
    return hash_ranked(df.select(F.col(subject).alias("subject")).where(F.col("subject").isNotNull()).distinct(), seed)


def draw_lists(places: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """(position, reps): the repetitions that draw a subject, once per draw; n subjects are drawn in each.

    Subjects never drawn have no row. Draws are made and shuffled, as (position, repetition), in as many
    tasks as the session's shuffles have: a place is a few bytes but stands for ``repetitions`` draws, so
    their number must not follow the size of the input. The lists stay where the draws were shuffled to.
    """
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Every place stands for one draw number of each repetition.
    ship_package(places.sparkSession)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, size = (batch.column(c).to_numpy() for c in ("position", "size"))
            together = max(1, DRAWS_TOGETHER // max(1, len(numbers)))
            for start in range(1, repetitions + 1, together):
                reps = np.arange(start, min(start + together, repetitions + 1))
                drawn = seeded_hashes(seed, reps, numbers) % size
                yield pa.RecordBatch.from_pydict({"position": pa.array(drawn.reshape(-1)), "rep": pa.array(np.repeat(reps, len(numbers)).astype(np.int32))})

    return (
        places.repartition(tasks, "position").select("position", F.col("size").cast("bigint").alias("size"))
        .mapInArrow(draw, "position bigint, rep int")
        .repartition(tasks, "position")
        .groupBy("position")
        .agg(F.collect_list("rep").alias("reps"))
    )


def resample_blocks(df: DataFrame, subject: str, seed: int) -> DataFrame:
    """One resample: every row of a drawn subject, once per draw (``copy`` numbers the repeats)."""
    places = subject_places(df, subject, seed)
    picked = draw_lists(places, 1, seed).join(places, "position").select(F.col("subject").alias(subject), F.size("reps").alias("times"))
    return (
        lookup_join(df, picked, subject)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times").cast("bigint"))))
        .drop("times")
    )


def _weights(batch: pa.RecordBatch, repetitions: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The predictions of a batch, the first one of every distinct kind, and its weight per repetition."""
    reps, rows = batch.column("reps"), batch.column("rows").flatten()
    groups = np.arange(len(batch))
    own = np.repeat(groups, reps.value_lengths().to_numpy(zero_copy_only=False))
    hits = reps.flatten().to_numpy(zero_copy_only=False).astype(np.int64) - 1
    times = np.bincount(own * repetitions + hits, minlength=len(batch) * repetitions).reshape(len(batch), repetitions)
    number = lambda c: rows.field(c).to_numpy(zero_copy_only=False).astype(float)
    probs = rows.field("prob").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    keys = np.column_stack([number("truth"), number("called"), probs])
    _, first, kind = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    same = np.zeros((len(first), len(batch)))
    group = np.repeat(groups, batch.column("rows").value_lengths().to_numpy(zero_copy_only=False))
    np.add.at(same, (kind.reshape(-1), group), number("same"))
    return rows, first, same @ times.astype(float)


def _sum_predictions(repetitions: int, scored: bool):
    """Subjects' predictions and draws -> weights per distinct prediction, and confusion cells, one set per task.

    A task holds at most ``HELD_WEIGHTS`` weights of predictions; when it is full they are handed on and
    begun anew, so a prediction may come in several parts.
    """
    held_at_once = max(1, HELD_WEIGHTS // repetitions)

    def out(kind: str, keys, weights, losses=None, briers=None) -> pa.RecordBatch:
        none = [None] * len(keys)
        lists = lambda vectors: pa.array(none if vectors is None else list(vectors), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * len(keys), pa.string()),
                pa.array([None if k[0] < 0 else k[0] for k in keys], pa.int32()),
                pa.array([None if k[1] < 0 else k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.list_(pa.float64())),
                lists(weights), lists(losses), lists(briers),
            ],
            ["kind", "truth", "called", "prob", "weights", "losses", "briers"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        cells: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for start in range(0, len(whole), held_at_once):
                batch = whole.slice(start, held_at_once)
                rows, first, weights = _weights(batch, repetitions)
                for row, vector in zip(rows.take(pa.array(first)).to_pylist(), weights):
                    cell = cells.setdefault((row["truth"], row["called"]), np.zeros((3, repetitions)))
                    cell += vector * np.array([[1.0], [row["loss"]], [row["brier"]]])
                    if scored:
                        key = (row["truth"], row["called"], tuple(row["prob"]))
                        if key in held:
                            held[key] += vector
                        else:
                            held[key] = vector.copy()
                if len(held) >= held_at_once:
                    yield out("prediction", list(held), held.values())
                    held = {}
        if held:
            yield out("prediction", list(held), held.values())
        if cells:
            keys = [(t, c, None) for t, c in cells]
            yield out("cell", keys, *([v[i] for v in cells.values()] for i in range(3)))

    return add


def _count_wins(classes: Sequence[int], repetitions: int):
    """Rows in (class_id, score) order -> per task and class the totals of each true class and the weight
    of the ordered pairs inside the task, as arrays over the repetitions."""
    pairs = [(a, b) for a in classes for b in classes if a != b]
    k = len(classes)
    index = {c: i for i, c in enumerate(classes)}
    names = ["class_id", "first_score", *[f"t{c}" for c in classes], *[f"w_{a}_{b}" for a, b in pairs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_id = score = first = None
        tie = below = wins = None

        def close_tie():
            for i, (a, b) in enumerate(pairs):
                wins[i] += tie[index[a]] * (below[index[b]] + tie[index[b]] / 2.0)
            below.__iadd__(tie)

        def result() -> pa.RecordBatch:
            close_tie()
            vectors = [pa.array([v], pa.list_(pa.float64())) for v in (*below, *wins)]
            return pa.RecordBatch.from_arrays([pa.array([class_id], pa.int32()), pa.array([first], pa.float64()), *vectors], names)

        for batch in batches:
            weights = batch.column("weights").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), repetitions)
            heads = zip(*(batch.column(c).to_pylist() for c in ("class_id", "score", "truth")))
            for (c, s, t), vector in zip(heads, weights):
                if c != class_id:
                    if class_id is not None:
                        yield result()
                    class_id, score, first = c, s, s
                    tie, below = np.zeros((k, repetitions)), np.zeros((k, repetitions))
                    wins = np.zeros((len(pairs), repetitions))
                elif s != score:
                    close_tie()
                    tie, score = np.zeros((k, repetitions)), s
                tie[index[t]] += vector
        if class_id is not None:
            yield result()

    schema = ", ".join(["class_id int", "first_score double", *[f"{n} array<double>" for n in names[2:]]])
    return run, schema


def _auc_per_repetition(predictions: DataFrame, classes: Sequence[int], repetitions: int) -> DataFrame:
    """AUC of every repetition: scores are cut into ranges, counted per range, and the ranges chained."""
    scored = predictions.where(F.col("truth").isin(*classes)).select(
        "truth", "weights", F.posexplode("prob").alias("class_id", "score")
    )
    run, schema = _count_wins(classes, repetitions)
    # Equal scores meet in one range, so ties never cross a border.
    ordered = scored.repartitionByRange("class_id", "score").sortWithinPartitions("class_id", "score")
    parts = ordered.mapInArrow(run, schema)
    names = [c for c in parts.columns if c not in ("class_id", "first_score")]
    per_rep = parts.select(
        "class_id", "first_score", F.posexplode(F.arrays_zip(*names)).alias("rep", "_v")
    ).select("class_id", "first_score", "rep", *[F.col(f"_v.{n}").alias(n) for n in names])
    # One row per range, class and repetition.
    before = Window.partitionBy("class_id", "rep").orderBy("first_score").rowsBetween(Window.unboundedPreceding, -1)
    chained = per_rep.withColumns({f"b{c}": F.coalesce(F.sum(f"t{c}").over(before), F.lit(0.0)) for c in classes})
    wins = chained.groupBy("rep", "class_id").agg(
        *[
            F.sum(F.col(f"w_{a}_{b}") + F.col(f"t{a}") * F.col(f"b{b}")).alias(f"w_{a}_{b}")
            for a in classes for b in classes if a != b
        ],
        *[F.sum(f"t{c}").alias(f"t{c}") for c in classes],
    )
    return auc_from_wins(wins, classes, ["rep"])


def repetition_metrics(
    df: DataFrame, subject: str, truth: str, prob: Column, repetitions: int, seed: int,
    classes: Sequence[int] = (0, 1, 2), predicted: Column | None = None, auc: bool = True,
) -> DataFrame:
    """The multiclass report of every repetition (column ``rep``, from 0)."""
    ship_package(df.sparkSession)
    call = predicted if predicted is not None else P.predicted_class(prob)
    whole = lambda c: F.coalesce(c.cast("int"), F.lit(-1))  # noqa: E731  (-1 stands for null)
    rows = df.select(
        F.col(subject).alias("subject"), whole(F.col(truth)).alias("truth"), whole(call).alias("called"), prob.alias("prob")
    ).where(F.col("prob").isNotNull())
    # Equal predictions of a subject are counted before they meet its draws.
    merged = rows.groupBy("subject", "truth", "called", "prob").agg(F.count("*").cast("double").alias("same"))
    known = F.when(F.col("truth") >= 0, F.col("truth"))
    places = materialize(subject_places(df, subject, seed), "places")
    placed = materialize(
        lookup_join(merged, places.select("subject", "position"), "subject").select(
            "position",
            F.struct(
                "truth", "called", "prob", "same",
                F.coalesce(P.clipped_log_loss(F.get("prob", known)), F.lit(0.0)).alias("loss"),
                F.coalesce(P.brier(F.col("prob"), known, len(classes)), F.lit(0.0)).alias("brier"),
            ).alias("row"),
        ),
        "placed",
    )
    # A subject's rows meet its draws in lists of ROWS_TOGETHER on average, however many rows it has.
    counts = placed.groupBy("position").agg(F.count("*").alias("_rows"))
    lists = F.ceil(F.col("_rows") / F.lit(ROWS_TOGETHER))
    grouped = (
        lookup_join(placed, counts, "position")
        .groupBy("position", F.pmod(F.xxhash64("row"), lists).alias("part"))
        .agg(F.collect_list("row").alias("rows"))
    )
    drawn = salted_join(
        grouped, draw_lists(places, repetitions, seed), ["position"], "inner", F.col("part"),
        counts=counts.select("position", lists.alias("_rows")),
        min_rows=max(1, MIN_HOT_ROWS // repetitions),
    ).select("rows", "reps")
    summed = materialize(drawn.mapInArrow(_sum_predictions(repetitions, auc), _PARTIAL), "bootstrap")
    cells = (
        summed.where("kind = 'cell'")
        .select(
            F.col("truth").alias("_t"), F.col("called").alias("_p"),
            F.posexplode(F.arrays_zip("weights", "losses", "briers")).alias("rep", "_v"),
        )
        .groupBy("rep", "_t", "_p")
        .agg(F.sum("_v.weights").alias("n"), F.sum("_v.losses").alias("ll"), F.sum("_v.briers").alias("br"))
        .where("n > 0")
    )
    release(places, placed)
    report = metrics_from_cells(cells, classes, ["rep"])
    if not auc:
        return report
    ranks = _auc_per_repetition(summed.where("kind = 'prediction'"), classes, repetitions)
    return report.join(ranks, "rep", "left")


def subject_bootstrap_ci(
    df: DataFrame,
    subject: str,
    truth: str,
    prob: Column,
    repetitions: int = 1000,
    confidence_level: float = 0.95,
    seed: int = 42,
    classes: Sequence[int] = (0, 1, 2),
    metrics: Sequence[str] = METRICS,
    predicted: Column | None = None,
) -> DataFrame:
    """Percentile interval of each metric with its estimate on the original rows.

    ``predicted`` replaces the class of the largest probability, as after a threshold rule. Rows without a
    subject count in the estimate only, rows without probabilities in neither. Metrics that a repetition
    does not define are left out of its interval; ``valid_repetitions`` counts the others.
    """
    known = df.where(prob.isNotNull())
    auc = "roc_auc_ovr" in metrics
    per_rep = repetition_metrics(known, subject, truth, prob, repetitions, seed, classes, predicted, auc)
    estimate = multiclass_metrics(known, truth, prob, classes, predicted=predicted, auc=auc)
    tail = (1.0 - confidence_level) / 2.0
    long = per_rep.unpivot(["rep"], list(metrics), "metric", "value")
    # `percentile` holds one value per repetition here, so its buffer is bounded by `repetitions`.
    bounds = long.groupBy("metric").agg(
        F.percentile("value", F.lit(tail)).alias("ci_lower"),
        F.percentile("value", F.lit(1.0 - tail)).alias("ci_upper"),
        F.count("value").alias("valid_repetitions"),
    )
    points = estimate.unpivot([], list(metrics), "metric", "estimate")
    return points.join(bounds, "metric", "left").select(
        "metric", "estimate", "ci_lower", "ci_upper", F.coalesce("valid_repetitions", F.lit(0)).alias("valid_repetitions"),
        F.lit("subject").alias("bootstrap_unit"),
    )
