"""Record selection and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from visitline.functions.dates import is_calendar_date, parse_visit_date


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Best row per key.

    The rank filter lets Spark drop losing rows before the shuffle (window group limit), so a key
    with very many rows sends one row per input partition, not all of them.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def _sortable_date(df: DataFrame, date_col: str) -> Column:
    if is_calendar_date(df, date_col) or isinstance(df.schema[date_col].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.col(date_col)
    return parse_visit_date(date_col)


def baseline_records(
    df: DataFrame, subject_col: str, visit_col: str | None, date_col: str | None, row_id: str, code: str = "bl"
) -> DataFrame:
    """One row per subject: its baseline-coded visit, else the earliest dated one."""
    order = []
    if visit_col and visit_col in df.columns:
        is_baseline = F.coalesce(F.lower(F.trim(F.col(visit_col).cast("string"))) == code, F.lit(False))
        order.append(is_baseline.desc())
    if date_col and date_col in df.columns:
        order.append(_sortable_date(df, date_col).asc_nulls_last())
    return first_per_key(df, [subject_col], [*order, F.col(row_id).asc()])


def task_rows(
    df: DataFrame, task_mode: str, subject_col: str, visit_col: str, date_col: str, row_id: str, code: str = "bl"
) -> DataFrame:
    """``all_visits`` keeps everything; ``baseline_only`` keeps one row per subject.

    Baseline-coded rows are used when the table holds any, otherwise the whole table is.
    """
    if task_mode == "all_visits":
        return df
    if task_mode != "baseline_only":
        raise ValueError(f"Unsupported task_mode: {task_mode}")
    pool = df
    if visit_col in df.columns:
        coded = F.coalesce(F.lower(F.col(visit_col).cast("string")) == code, F.lit(False))
        any_coded = df.agg(F.max(coded)).scalar()
        pool = df.where(coded | ~F.coalesce(any_coded, F.lit(False)))
    order = [_sortable_date(df, date_col).asc_nulls_last()] if date_col in df.columns else []
    return first_per_key(pool, [subject_col], [*order, F.col(row_id).asc()])


def latest_records(df: DataFrame, subject_col: str, date_col: str, row_id: str) -> DataFrame:
    """Latest dated row per subject; later source rows win ties and undated subjects keep a row."""
    order = [_sortable_date(df, date_col).desc_nulls_last(), F.col(row_id).desc()]
    return first_per_key(df, [subject_col], order)


def selection_audit(df: DataFrame, selected: DataFrame, subject_col: str, date_col: str, row_id: str) -> DataFrame:
    """Every source row with a flag telling whether it was selected."""
    chosen = selected.select(row_id, F.lit(True).alias("selected"))
    return (
        df.select(subject_col, date_col, row_id)
        .join(chosen, row_id, "left")
        .withColumn("selected", F.coalesce("selected", F.lit(False)))
    )


def first_follow_up(df: DataFrame, subject_col: str, outcome_date: str, row_id: str) -> DataFrame:
    return first_per_key(df, [subject_col], [F.col(outcome_date).asc_nulls_last(), F.col(row_id).asc()])


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_per_key(df, keys, order)


# --- columns -----------------------------------------------------------------------------------

# Label-derived columns that never enter a feature list, with the audited reason.
ALWAYS_BLOCKED = {
    "DX": "Target diagnosis label; including it would directly leak the answer.",
    "DXCHANGE": "Diagnosis transition code derived from diagnosis state; leaks target information.",
}
BASELINE_BLOCKED = {
    "DX_bl": "Baseline diagnosis is diagnosis-derived and overlaps with the target.",
    "VISCODE": "Baseline-only task filters to baseline visits, so visit code is not a model feature.",
}
ALL_VISITS_BLOCKED = {
    "DX_bl": "Baseline diagnosis is diagnosis-derived; excluded from main all-visits model.",
    "VISCODE": "Visit code may encode follow-up timing and is excluded by default.",
}


def feature_blacklist(
    task_mode: str = "all_visits",
    df: DataFrame | None = None,
    exclude_visit_code: bool = True,
    always: Mapping[str, str] = ALWAYS_BLOCKED,
    baseline: Mapping[str, str] = BASELINE_BLOCKED,
    all_visits: Mapping[str, str] = ALL_VISITS_BLOCKED,
    visit_code: str = "VISCODE",
) -> dict[str, str]:
    """Leakage-prone columns with reasons, limited to the columns of ``df`` when given."""
    by_task = dict(baseline if task_mode == "baseline_only" else all_visits)
    if task_mode != "baseline_only" and not exclude_visit_code:
        by_task.pop(visit_code, None)
    blocked = {**always, **by_task}
    return blocked if df is None else {c: why for c, why in blocked.items() if c in df.columns}


def without_blacklisted(features: Sequence[str], blacklist: Mapping[str, str]) -> list[str]:
    return [f for f in features if f not in blacklist]


def group_columns(df: DataFrame, groups: Mapping[str, Sequence[str]], wanted: Sequence[str]) -> list[str]:
    """Present columns of the wanted feature groups, first mention first."""
    present = set(df.columns)
    return list(dict.fromkeys(c for g in wanted for c in groups.get(g, []) if c in present))


def available_groups(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    present = set(df.columns)
    return {g: [c for c in cols if c in present] for g, cols in groups.items()}


def select_groups(
    df: DataFrame, ids: Sequence[str], groups: Mapping[str, Sequence[str]], wanted: Sequence[str]
) -> DataFrame:
    return df.select(*ids, *group_columns(df, groups, wanted))


def mask_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null out a feature group, keeping every column type."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns if c in df.columns})


def align_to_schema(df: DataFrame, frozen: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the frozen columns in frozen order; absent ones are null, extra ones are dropped."""
    present = set(df.columns)
    return df.select(
        *[c for c in keep if c not in frozen.fieldNames()],
        *[
            F.col(f.name).try_cast(f.dataType).alias(f.name)
            if f.name in present
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in frozen.fields
        ],
    )


def any_available(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns], F.lit(False))


def missing_fraction(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns]) / F.lit(float(len(columns)))


def with_abstention(df: DataFrame, confidence_col: str, threshold: float | Column) -> DataFrame:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.withColumn("abstained", ~(F.col(confidence_col) >= limit))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"Missing required columns: {', '.join(absent)}")
