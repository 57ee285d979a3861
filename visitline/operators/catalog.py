"""Profiling a wide table and deciding the use of each of its columns.

The profile is computed in long form: every (column, value) pair is counted with map-side
aggregation, so missing, non-null and distinct counts of any number of columns take one shuffle that
is spread by column *and* value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from visitline.functions.names import column_role, measurement_family
from visitline.operators.selection import any_available, baseline_records

DICTIONARY_FIELDS = ("FLDNAME", "TBLNAME", "TEXT", "TYPE", "UNITS")

# Roles that may become model features, their order and their feature quotas.
FEATURE_QUOTAS = {
    "demographic": 12,
    "cognitive": 40,
    "mri_structural": 50,
    "mri_dti": 35,
    "pet_fdg": 15,
    "pet_amyloid": 15,
    "pet_other": 15,
    "csf": 10,
    "genetic": 5,
    "biofluid_other": 3,
}
LEAKAGE_ROLES = ("label", "baseline_diagnosis", "visit_time")
SUSPECT_ROLES = ("identifier", "visit_time", "label", "baseline_diagnosis", "administrative")
BLOCKED_STATUSES = (
    "exclude_leakage",
    "exclude_identifier",
    "exclude_administrative",
    "exclude_high_missing",
    "exclude_duplicate",
    "exclude_unresolved",
)
# Explanation stored with each status.
REASONS = {
    "exclude_leakage": "Target-derived or temporal field is excluded from model inputs.",
    "exclude_identifier": "Identifier is retained only for joins and subject-level splits.",
    "exclude_administrative": "Administrative or data-construction field.",
    "exclude_unresolved": "Field meaning or modeling role is not resolved for the primary set.",
    "exclude_high_missing": "Availability is below the configured feature threshold.",
    "exclude_duplicate": "A better-covered representative from the same measurement family was retained.",
    "include_optional": "Eligible audited feature retained as optional but outside the primary feature cap.",
    "include_primary": "",
}


def _as_text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    text = F.to_json(c) if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
    if isinstance(field.dataType, T.NumericType):
        return text
    # Long texts are told apart by their digest, so that counting them does not move them whole.
    return F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, relative_error: float | None = None) -> DataFrame:
    """Missing rate, non-null count and distinct count of every column.

    Distinct counts are exact, for which every (column, value) is shuffled once. With ``relative_error``
    they come from sketches of that standard error, and one row per column and task is shuffled.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in set(columns)]
    cells = F.array(*[F.struct(F.lit(f.name).alias("column_name"), _as_text(f).alias("v")) for f in fields])
    if relative_error is not None:
        return df.select(F.inline(cells)).groupBy("column_name").agg(
            F.avg(F.col("v").isNull().cast("double")).alias("missing_rate"),
            F.count("v").alias("non_missing_count"),
            F.approx_count_distinct("v", relative_error).alias("unique_count"),
        )
    counted = df.select(F.inline(cells)).groupBy("column_name", "v").agg(F.count("*").alias("n"))
    return counted.groupBy("column_name").agg(
        (F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("missing_rate"),
        F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).cast("bigint").alias("non_missing_count"),
        F.count("v").alias("unique_count"),
    )


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing rate per column from one aggregate over the table."""
    names = list(columns or df.columns)
    wide = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in names])
    return wide.unpivot([], names, "column_name", "missing_rate")


def table_audit(
    df: DataFrame, subject: str, visit: str, label: str, high_missing: float = 0.60
) -> dict[str, DataFrame]:
    """Small frames describing a table: ``summary``, ``labels`` and ``missing``."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    missing = missing_rates(df).withColumn("over_threshold", F.col("missing_rate") > high_missing)
    labels = df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("<missing>")).alias("label")).agg(
        F.count("*").alias("rows")
    )
    # Reduced to visit keys, then to subjects, so neither distinct count gathers rows in one task.
    visits = df.groupBy(F.col(subject).alias("s"), F.col(visit).alias("v")).agg(F.count("*").alias("n"))
    subjects = visits.groupBy("s").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("extra"))
    summary = subjects.agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        F.count("s").alias("n_subjects"),
        F.sum("extra").cast("bigint").alias("duplicate_subject_visit_rows"),
    ).withColumns(
        {
            "n_columns": F.lit(len(df.columns)),
            "numeric_columns": F.lit(len(numeric)),
            "categorical_columns": F.lit(len(df.columns) - len(numeric)),
        }
    )
    return {"summary": summary, "labels": labels, "missing": missing}


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of every key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")
    )


# --- dictionary --------------------------------------------------------------------------------


def dictionary_index(dictionary: DataFrame, position: str) -> DataFrame:
    """One entry per lower-cased field name: most filled fields, then earliest ``position``."""
    filled = sum(
        (F.when(F.col(c) != "", 1).otherwise(0) for c in DICTIONARY_FIELDS[2:]),
        F.when(F.col(DICTIONARY_FIELDS[1]) != "", 1).otherwise(0),
    )
    named = dictionary.withColumn("_name", F.trim("FLDNAME")).where(
        (F.col("_name") != "") & (F.upper("_name") != "FLDNAME")
    )
    lane = Window.partitionBy(F.lower("_name")).orderBy(filled.desc(), F.col(position).asc())
    best = named.withColumn("_rank", F.row_number().over(lane)).where(F.col("_rank") == 1)
    return best.select(F.lower("_name").alias("key"), *DICTIONARY_FIELDS)


def match_dictionary(columns: DataFrame, dictionary: DataFrame, position: str, name: str = "column_name") -> DataFrame:
    """Dictionary entry of each column by case-insensitive name; unmatched columns keep nulls."""
    index = dictionary_index(dictionary, position)
    return (
        columns.withColumn("key", F.lower(name))
        .join(index, "key", "left")
        .withColumn("dictionary_match", F.col("FLDNAME").isNotNull())
        .drop("key")
    )


# --- catalog -----------------------------------------------------------------------------------


def initial_status(role: Column, missing_rate: Column, count: Column, max_missing: float, min_count: int) -> Column:
    return (
        F.when(role.isin(*LEAKAGE_ROLES), "exclude_leakage")
        .when(role == "identifier", "exclude_identifier")
        .when(role == "administrative", "exclude_administrative")
        .when(~role.isin(*FEATURE_QUOTAS), "exclude_unresolved")
        .when((missing_rate > max_missing) | (count < min_count), "exclude_high_missing")
        .otherwise("include_optional")
    )


def _preference() -> list[Column]:
    return [
        F.desc("available_in_scoring"), F.asc("missing_rate"), F.desc("dictionary_match"), F.asc("column_name"),
    ]


def drop_family_duplicates(catalog: DataFrame, keep: int = 1) -> DataFrame:
    """Candidates beyond the best ``keep`` of a measurement family become ``exclude_duplicate``."""
    candidate = F.col("recommended_use") == "include_optional"
    lane = Window.partitionBy("measurement_family", candidate).orderBy(*_preference())
    return (
        catalog.withColumn("_rank", F.row_number().over(lane))
        .withColumn(
            "recommended_use",
            F.when(candidate & (F.col("_rank") > keep), "exclude_duplicate").otherwise(F.col("recommended_use")),
        )
        .drop("_rank")
    )


def select_primary(catalog: DataFrame, max_features: int = 200, quotas: Mapping[str, int] = FEATURE_QUOTAS) -> DataFrame:
    """Best candidates per role up to its quota, roles in quota order, until the cap is reached."""
    from visitline.functions.states import literal_map

    order = F.try_element_at(literal_map({r: i for i, r in enumerate(quotas)}), F.col("role"))
    quota = F.try_element_at(literal_map(dict(quotas)), F.col("role"))
    candidate = F.col("recommended_use") == "include_optional"
    in_role = Window.partitionBy("role", candidate).orderBy(*_preference())
    ranked = catalog.withColumns({"_place": F.row_number().over(in_role), "_order": order, "_quota": quota})
    taken = candidate & (F.col("_place") <= F.coalesce(F.col("_quota"), F.lit(0)))
    # One row per column of the audited table: a bounded frame.
    running = Window.partitionBy(F.lit(0)).orderBy(F.col("_order").asc_nulls_last(), "_place", "column_name").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    so_far = F.sum(taken.cast("int")).over(running)
    return (
        ranked.withColumn("_so_far", so_far)
        .withColumn(
            "recommended_use",
            F.when(taken & (F.col("_so_far") <= max_features), "include_primary").otherwise(F.col("recommended_use")),
        )
        .drop("_place", "_order", "_quota", "_so_far")
    )


def build_catalog(
    df: DataFrame,
    dictionary: DataFrame,
    position: str,
    scoring_columns: Sequence[str] = (),
    max_missing: float = 0.70,
    min_count: int = 100,
    per_family: int = 1,
    max_features: int = 200,
) -> DataFrame:
    """One audited row per column of ``df``."""
    if per_family < 1:
        raise ValueError("per_family must be at least 1")
    profile = match_dictionary(column_profile(df), dictionary, position)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    in_scoring = F.col("column_name").isin(*scoring_columns) if scoring_columns else F.lit(False)
    rows = profile.select(
        "column_name",
        "dictionary_match",
        text("TBLNAME").alias("source_table"),
        text("TEXT").alias("description"),
        text("TYPE").alias("type"),
        text("UNITS").alias("units"),
        "missing_rate",
        "non_missing_count",
        "unique_count",
        in_scoring.alias("available_in_scoring"),
    ).withColumn("role", column_role(F.col("column_name"), F.col("source_table"), F.col("description")))
    rows = rows.withColumns(
        {
            "recommended_use": initial_status(
                F.col("role"), F.col("missing_rate"), F.col("non_missing_count"), max_missing, min_count
            ),
            "missing_rate": F.round("missing_rate", 6),
            "suspected_label": F.col("role").isin("label", "baseline_diagnosis"),
            "suspected_leakage": F.col("role").isin(*SUSPECT_ROLES),
            "measurement_family": measurement_family(F.col("column_name")),
        }
    )
    chosen = select_primary(drop_family_duplicates(rows, per_family), max_features)
    from visitline.functions.states import literal_map

    return chosen.withColumn("exclusion_reason", F.try_element_at(literal_map(REASONS), F.col("recommended_use")))


def blacklist(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("recommended_use").isin(*BLOCKED_STATUSES)).select("column_name", "exclusion_reason")


def whitelist(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("recommended_use") == "include_primary").select("column_name")


def role_summary(catalog: DataFrame) -> DataFrame:
    """Columns, best missing rate, eligible and primary columns per role."""
    use = F.col("recommended_use")
    return catalog.groupBy("role").agg(
        F.count("*").alias("total_columns"),
        F.min("missing_rate").alias("best_missing_rate"),
        F.count_if(use.isin("include_primary", "include_optional")).alias("eligible"),
        F.count_if(use == "include_primary").alias("primary"),
    )


def catalog_summary(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count("*").alias("columns"),
        F.count_if("dictionary_match").alias("dictionary_matches"),
        F.count_if(F.col("recommended_use") == "include_primary").alias("primary_features"),
    )


def exclusion_counts(catalog: DataFrame) -> DataFrame:
    return (
        catalog.where(F.col("recommended_use").isin(*BLOCKED_STATUSES))
        .groupBy(F.col("recommended_use").alias("rule"))
        .agg(F.count("*").alias("columns"))
    )


# Roles that are too sparse for the default feature groups.
SPARSE_ROLES = ("mri_dti", "csf", "pet_other")


def feature_groups(catalog: DataFrame, features: Sequence[str], sparse: Sequence[str] = SPARSE_ROLES) -> dict[str, list[str]]:
    """Role -> its chosen features; features without an entry and sparse roles are errors.

    The result is schema-sized: it never holds more entries than ``features``.
    """
    wanted = list(dict.fromkeys(features))
    rows = catalog.where(F.col("column_name").isin(*wanted)).select("role", "column_name").collect()
    absent = sorted(set(wanted) - {r["column_name"] for r in rows})
    if absent:
        raise ValueError(f"Features missing from the catalog: {', '.join(absent)}")
    groups: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["role"], r["column_name"])):
        groups.setdefault(r["role"], []).append(r["column_name"])
    if set(sparse) & set(groups):
        raise ValueError("A sparse role entered the default feature groups.")
    return groups


def feature_group_table(catalog: DataFrame, features: DataFrame) -> DataFrame:
    """The same lookup as a frame: role and its sorted features."""
    return (
        catalog.join(features.select("column_name"), "column_name")
        .groupBy("role")
        .agg(F.array_sort(F.collect_list("column_name")).alias("features"))
    )


def suspicious_top_features(
    importance: DataFrame,
    forbidden: Sequence[str] = ("RID", "DX", "DXCHANGE", "VISCODE"),
    prefixes: Sequence[str] = ("SITE", "COLPROT", "ORIGPROT", "EXAMDATE"),
    top: int = 20,
) -> DataFrame:
    """Forbidden or site / date features among the most important ones."""
    head = importance.orderBy(F.desc("importance"), F.asc("feature")).limit(top)
    named = F.col("feature").isin(*forbidden)
    for p in prefixes:
        named = named | F.upper("feature").startswith(p)
    return head.where(named)


# --- cohort report -----------------------------------------------------------------------------


def class_counts(df: DataFrame, label: str, subject: str) -> DataFrame:
    per_subject = df.groupBy(F.col(label).alias("label"), F.col(subject).alias("s")).agg(F.count("*").alias("n"))
    return per_subject.groupBy("label").agg(F.sum("n").cast("bigint").alias("rows"), F.count("*").alias("subjects"))


def group_availability(df: DataFrame, subject: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per feature group: its size and the subjects with any value in it."""
    per_subject = df.groupBy(subject).agg(*[F.max(any_available(cols)).alias(g) for g, cols in groups.items()])
    wide = per_subject.agg(*[F.count_if(F.col(g)).alias(g) for g in groups])
    long = wide.unpivot([], list(groups), "feature_group", "available_subjects")
    size = F.lit(None).cast("int")
    for g, cols in groups.items():
        size = F.when(F.col("feature_group") == g, F.lit(len(cols))).otherwise(size)
    return long.withColumn("features", size)


def cohort_exclusions(source: DataFrame, selected: DataFrame, subject: str, state: str = "state") -> DataFrame:
    """Source subjects, selected rows without a state, and what is left."""
    n_source = source.select(subject).where(F.col(subject).isNotNull()).distinct().agg(F.count("*")).scalar()
    kept = selected.where(F.col(state).isNotNull()).groupBy(subject).agg(F.count("*").alias("n"))
    left = kept.agg(F.count("*").alias("included_subjects"), F.sum("n").cast("bigint").alias("included_visits"))
    invalid = selected.agg(F.count_if(F.col(state).isNull())).scalar()
    return left.withColumns({"source_subjects": n_source, "invalid_or_missing_state_rows": invalid})


def sparse_group_cohort(
    df: DataFrame, features: Sequence[str], subject: str, state: str, visit: str | None, date: str, row_id: str, n_states: int = 3
) -> DataFrame:
    """Size, class coverage and verdict for the cohort that has any value of a sparse group."""
    valid = df.where(F.col(state).isNotNull())
    cohort = valid.where(any_available(features))
    main = baseline_records(valid, subject, visit, date, row_id).select(subject)
    cells = F.array(*[F.col(c).isNull().cast("double") for c in features])
    per_subject = cohort.groupBy(subject).agg(
        F.count("*").alias("n"),
        F.sum(F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / F.lit(float(len(features)))).alias("missing"),
    )
    present = per_subject.join(main.withColumn("in_main", F.lit(1)), subject, "left")
    states = cohort.select(state).distinct().agg(F.count("*")).scalar()
    out = present.agg(
        F.count("*").alias("available_subjects"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("available_visits"),
        F.count("in_main").alias("main_cohort_intersection"),
        (F.sum("missing") / F.sum("n")).alias("mean_feature_missing_rate"),
    ).withColumns(
        {"main_cohort_subjects": main.agg(F.count("*")).scalar(), "feature_count": F.lit(len(features)), "_states": states}
    )
    # Size limits and wording of the verdict.
    verdict = (
        F.when(
            (F.col("available_subjects") >= 300) & (F.col("_states") == n_states),
            "Potentially useful as a separate cohort with dedicated validation.",
        )
        .when(
            (F.col("available_subjects") >= 100) & (F.col("_states") >= 2),
            "Exploratory only; cohort size or class coverage limits robust comparison.",
        )
        .otherwise("Insufficient for a reliable standalone three-class experiment.")
    )
    return out.withColumn("modeling_value", verdict).drop("_states")
