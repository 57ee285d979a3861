"""Time-to-event operators: index visits, landmarks, person-periods and cumulative risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from visitline.functions.dates import instant, months, ticks_per_day, whole_days
from visitline.functions.ordered import exact_quantiles
from visitline.functions.states import DEFAULT_SCHEME, StateScheme, normalize_state
from visitline.operators.selection import first_per_key, missing_fraction, require_columns


def index_visits(
    df: DataFrame,
    features: Sequence[str],
    subject: str,
    date: str,
    label: str,
    row_id: str,
    at_risk: str = "MCI",
    event: str = "AD",
    scheme: StateScheme = DEFAULT_SCHEME,
) -> DataFrame:
    """First visit in the at-risk state of every subject that is seen again on a later date.

    ``max_followup_months`` runs to the last visit, ``first_event_months`` to the first later visit
    in the event state (null when there is none). Follow-up is aggregated on visits collapsed to
    (subject, instant), so a long history is reduced before it is joined.
    """
    require_columns(df, [subject, date, label, row_id, *features])
    ticks = ticks_per_day(df, date)
    visits = df.select(
        F.col(subject).alias("subject"),
        F.col(date).alias("visit_date"),
        instant(df, date).alias("at"),
        F.col(row_id).alias("row_id"),
        normalize_state(F.col(label), scheme).alias("state"),
        *features,
    ).where(F.col("subject").isNotNull() & F.col("at").isNotNull() & F.col("state").isNotNull())
    first = first_per_key(
        visits.where(F.col("state") == at_risk), ["subject"], [F.col("at").asc(), F.col("row_id").asc()]
    )
    last_seen = visits.groupBy("subject").agg(F.max("at").alias("last_at"))
    events = visits.where(F.col("state") == event).select("subject", F.col("at").alias("event_at")).distinct()
    first_event = (
        first.select("subject", "at")
        .join(events, "subject")
        .where(F.col("event_at") > F.col("at"))
        .groupBy("subject")
        .agg(F.min("event_at").alias("event_at"))
    )
    return (
        first.join(last_seen, "subject")
        .where(F.col("last_at") > F.col("at"))
        .join(first_event, "subject", "left")
        .select(
            "subject",
            F.date_format("visit_date", "yyyy-MM-dd").alias("source_date"),
            months(whole_days(F.col("at"), F.col("last_at"), ticks)).alias("max_followup_months"),
            months(whole_days(F.col("at"), F.col("event_at"), ticks)).alias("first_event_months"),
            *features,
        )
    )


def landmark_label(horizon: Column, tolerance: float = 6) -> Column:
    """1 = event by horizon + tolerance, 0 = event-free and followed to horizon - tolerance, null = censored."""
    converted = F.col("first_event_months").isNotNull() & (F.col("first_event_months") <= horizon + F.lit(tolerance))
    return F.when(converted, 1).when(F.col("max_followup_months") >= horizon - F.lit(tolerance), 0)


def landmark_rows(index: DataFrame, horizons: Sequence[float], tolerance: float = 6) -> DataFrame:
    """Each index visit once per horizon, with label (null when censored) and window bounds."""
    wide = index.withColumn("horizon_months", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    return wide.withColumns(
        {
            "lower_months": F.col("horizon_months") - F.lit(float(tolerance)),
            "upper_months": F.col("horizon_months") + F.lit(float(tolerance)),
            "label": landmark_label(F.col("horizon_months"), tolerance),
        }
    )


def landmark_cohort(index: DataFrame, horizon: float, tolerance: float = 6) -> DataFrame:
    return landmark_rows(index, [horizon], tolerance).where(F.col("label").isNotNull())


def landmark_summary(
    rows: DataFrame,
    features: Sequence[str],
    numeric: Sequence[str] = (),
    category: tuple[str, str] | None = None,
) -> DataFrame:
    """Counts, prevalence and covariates of the eligible subjects per horizon, in one aggregate.

    ``category`` is a (column, value) whose case-folded share is reported.
    """
    eligible = F.col("label").isNotNull()
    aggs = [
        F.count_if(eligible).alias("eligible_subjects"),
        F.count_if(F.col("label") == 1).alias("converters"),
        F.count_if(F.col("label") == 0).alias("non_converters"),
        F.count_if(~eligible).alias("censored_subjects"),
        F.avg(F.col("label").cast("double")).alias("class_prevalence"),
        *[F.avg(F.when(eligible, F.col(c).try_cast("double"))).alias(f"{c}_mean") for c in numeric],
    ]
    if category:
        col, value = category
        folded = F.coalesce(F.lower(F.col(col).cast("string")) == value.lower(), F.lit(False)).cast("double")
        aggs.append(F.avg(F.when(eligible, folded)).alias(f"{col}_fraction"))
    if features:
        aggs.append(F.avg(F.when(eligible, missing_fraction(features))).alias("feature_missing_rate"))
    return rows.groupBy("horizon_months").agg(*aggs)


def person_periods(index: DataFrame, interval_ends: Sequence[int]) -> DataFrame:
    """One row per subject and observed interval, ending with the event interval.

    The rows of a subject are built inside its own row, so the subject weight is 1 / array size
    and nothing is shuffled.
    """
    starts = [0.0, *[float(e) for e in interval_ends[:-1]]]
    event_at = F.col("first_event_months")
    cells = []
    for i, (start, end) in enumerate(zip(starts, interval_ends), 1):
        event = F.coalesce((event_at > F.lit(start)) & (event_at <= F.lit(float(end))), F.lit(False))
        before_event = event_at.isNull() | (event_at > F.lit(start))
        seen = before_event & (event | (F.col("max_followup_months") >= F.lit(float(end))))
        cells.append(
            F.struct(
                F.lit(i).alias("interval_index"),
                F.lit(start).alias("interval_start_months"),
                F.lit(int(end)).alias("elapsed_months"),
                event.cast("int").alias("event"),
                seen.alias("seen"),
            )
        )
    kept = F.filter(F.array(*cells), lambda c: c["seen"])
    return (
        index.withColumn("_cells", kept)
        .withColumn("subject_weight", F.lit(1.0) / F.size("_cells"))
        .withColumn("_cell", F.explode("_cells"))
        .select(
            *index.columns,
            F.col("_cell.interval_index").alias("interval_index"),
            F.col("_cell.interval_start_months").alias("interval_start_months"),
            F.col("_cell.elapsed_months").alias("elapsed_months"),
            F.col("_cell.event").alias("event"),
            F.col("_cell.event").alias("label"),
            "subject_weight",
        )
    )


def risk_grid(index: DataFrame, interval_ends: Sequence[int]) -> DataFrame:
    """Every interval of every index visit, ready to be scored for its hazard."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("interval_index"), F.lit(int(end)).alias("elapsed_months"))
            for i, end in enumerate(interval_ends, 1)
        ]
    )
    return index.select("*", F.explode(cells).alias("_cell")).select("*", "_cell.*").drop("_cell")


def cumulative_risk(scored: DataFrame, subject: str = "subject", hazard: str = "hazard") -> DataFrame:
    """``1 - prod(1 - hazard)`` in interval order; a subject has one row per interval only."""
    lane = (
        Window.partitionBy(subject).orderBy("interval_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return scored.withColumn("cumulative_risk", F.lit(1.0) - F.product(F.lit(1.0) - F.col(hazard)).over(lane))


def risk_curve(risk: DataFrame, horizon: str = "elapsed_months", value: str = "cumulative_risk") -> DataFrame:
    """Mean and exact median cumulative risk per horizon."""
    means = risk.groupBy(horizon).agg(F.avg(value).alias("mean_risk"))
    medians = exact_quantiles(risk, value, [0.5], ["median_risk"], [horizon])
    return means.join(medians, horizon)
