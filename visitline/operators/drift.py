"""Training-versus-scoring comparison, schema compatibility and outcome matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from visitline.functions import probability as P
from visitline.functions.dates import months
from visitline.functions.ordered import collect_hits, quantile_from_hits, quantile_hits, running_sums, with_value_bucket
from visitline.functions.skew import lookup_join
from visitline.functions.states import OUTCOME_SCHEME, StateScheme, encode_state, normalize_state
from visitline.operators.catalog import missing_rates
from visitline.operators.selection import any_available
from visitline.session import materialize

# [design] PSI bins and the share that stands in for an empty bin; the source of the rule is not public.
PSI_BINS = 10
PSI_FLOOR = 1e-6


def _kind(df: DataFrame, column: str) -> str | None:
    if column not in df.columns:
        return None
    return "numeric" if isinstance(df.schema[column].dataType, T.NumericType) else "categorical"


def _long(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("v")) for c in columns])
    return df.select(F.inline(cells)).where(F.col("v").isNotNull())


def unseen_level_rows(train: DataFrame, scoring: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, v) for every scoring level training never had; both sides are reduced to levels first."""
    known = _long(train, columns, "string").distinct()
    return _long(scoring, columns, "string").distinct().join(known, ["feature", "v"], "left_anti")


def unseen_levels(train: DataFrame, scoring: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of unseen levels per categorical column that has any.

    The levels themselves are rows of :func:`unseen_level_rows`: a column may have as many as the scoring
    table has rows, which no single cell should hold.
    """
    return unseen_level_rows(train, scoring, columns).groupBy("feature").agg(F.count("*").alias("unseen_levels"))


def schema_compatibility(train: DataFrame, scoring: DataFrame, features: Sequence[str]) -> DataFrame:
    """Presence, missing rates, type agreement and unseen levels of every frozen feature."""
    spark = train.sparkSession
    kinds = [(f, _kind(train, f), _kind(scoring, f)) for f in features]
    # One row per feature of the frozen list: schema-sized.
    names = spark.createDataFrame(kinds, "feature string, train_kind string, scoring_kind string")
    rate = lambda df, name: missing_rates(df, [c for c in features if c in df.columns]).select(
        F.col("column_name").alias("feature"), F.col("missing_rate").alias(name)
    )
    both = [f for f, a, b in kinds if a == "categorical" and b is not None]
    out = names.join(rate(train, "train_missing_rate"), "feature", "left").join(
        rate(scoring, "scoring_missing_rate"), "feature", "left"
    )
    if both:
        out = out.join(unseen_levels(train, scoring, both), "feature", "left")
    else:
        out = out.withColumn("unseen_levels", F.lit(0).cast("bigint"))
    one = F.lit(1.0)
    return out.select(
        "feature",
        F.col("train_kind").isNotNull().alias("train_present"),
        F.col("scoring_kind").isNotNull().alias("scoring_present"),
        F.coalesce("train_missing_rate", one).alias("train_missing_rate"),
        F.coalesce("scoring_missing_rate", one).alias("scoring_missing_rate"),
        (F.coalesce("scoring_missing_rate", one) - F.coalesce("train_missing_rate", one)).alias("missing_rate_shift"),
        F.coalesce(F.col("train_kind") == F.col("scoring_kind"), F.lit(False)).alias("dtype_compatible"),
        F.coalesce("unseen_levels", F.lit(0)).cast("bigint").alias("unseen_levels"),
    )


def compatible_profile(candidates: Sequence[str], train: DataFrame | None, scoring: DataFrame) -> list[str]:
    """Candidate names present on both sides (or in scoring only when ``train`` is not given)."""
    known = set(scoring.columns) & (set(train.columns) if train is not None else set(scoring.columns))
    return [c for c in candidates if c in known]


def deployment_decision(
    compatibility: DataFrame, group_of: Mapping[str, str], required: Sequence[str], threshold: float = 0.95,
    full: str = "full", compact: str = "compact",
) -> DataFrame:
    """One row: may the full feature set be deployed, or is the compact one primary?"""
    from visitline.functions.states import literal_map

    tagged = compatibility.withColumn("_group", F.try_element_at(literal_map(dict(group_of)), F.col("feature")))
    usable = [
        F.coalesce(F.max((F.col("_group") == g) & F.col("scoring_present")), F.lit(False)).alias(f"_ok_{i}")
        for i, g in enumerate(required)
    ]
    mismatch = F.max(F.col("train_present") & F.col("scoring_present") & ~F.col("dtype_compatible"))
    row = tagged.agg(
        F.avg(F.col("scoring_present").cast("double")).alias("full_feature_presence_ratio"),
        mismatch.alias("severe_dtype_mismatch"),
        *usable,
    )
    all_groups = F.lit(True)
    for i in range(len(required)):
        all_groups = all_groups & F.col(f"_ok_{i}")
    ok = (F.col("full_feature_presence_ratio") >= threshold) & all_groups & ~F.col("severe_dtype_mismatch")
    return row.select(
        F.when(ok, full).otherwise(compact).alias("primary_candidate"),
        F.when(ok, compact).otherwise(full).alias("sensitivity_candidate"),
        ok.alias("full_compatible"),
        "full_feature_presence_ratio",
        F.lit(threshold).alias("feature_threshold"),
        all_groups.alias("required_groups_available"),
        "severe_dtype_mismatch",
    )


# --- distribution shift ------------------------------------------------------------------------


def numeric_shift(
    train: DataFrame, scoring: DataFrame, features: Sequence[str], bins: int = PSI_BINS, floor: float = PSI_FLOOR
) -> DataFrame:
    """Means, sample deviations, standardized mean difference, two-sample KS and PSI per feature.

    Both cohorts are reduced to counts per distinct value. One ordered pass over those counts gives
    the largest ECDF gap and the training quantiles that bound the PSI bins.
    """
    side = lambda df, s: _long(df, features, "double").withColumn("_scoring", F.lit(s))
    rows = side(train, 0).unionByName(side(scoring, 1))
    pick = lambda s: F.when(F.col("_scoring") == s, F.col("v"))
    moments = rows.groupBy("feature").agg(
        F.avg(pick(0)).alias("train_mean"), F.stddev_samp(pick(0)).alias("train_std"),
        F.avg(pick(1)).alias("scoring_mean"), F.stddev_samp(pick(1)).alias("scoring_std"),
    )
    pooled = F.sqrt((F.pow("train_std", F.lit(2.0)) + F.pow("scoring_std", F.lit(2.0))) / 2.0)
    smd = F.when(pooled > 0, (F.col("scoring_mean") - F.col("train_mean")) / pooled)
    # Written once: extremes, ordering and binning all read it, and the cohorts are not scanned again.
    counts = materialize(
        rows.groupBy("feature", "v").agg(
            F.count_if(F.col("_scoring") == 0).alias("a"), F.count_if(F.col("_scoring") == 1).alias("b")
        ),
        "value-counts",
    )
    ordered = _ks_and_edges(counts, bins)
    # One row per feature: frozen here, so that PSI does not order the values again.
    ordered = train.sparkSession.createDataFrame(ordered.collect(), ordered.schema)
    out = moments.withColumn("standardized_mean_difference", smd).join(ordered.drop("_edges"), "feature", "left")
    return out.join(_psi(counts, ordered.select("feature", "_edges"), floor, bins), "feature", "left")


def _ks_and_edges(counts: DataFrame, bins: int) -> DataFrame:
    """Per feature: the KS statistic and the inner training-quantile edges as an array."""
    ranked = running_sums(with_value_bucket(counts, "v", ["feature"]), ["v"], ["a", "b"], ["feature"])
    gap = F.abs(
        (F.col("a_before") + F.col("a")) / F.col("a_total") - (F.col("b_before") + F.col("b")) / F.col("b_total")
    )

    found = quantile_hits(
        F.col("v"), F.col("a_before"), F.col("a"), F.col("a_total"), [i / bins for i in range(1, bins)]
    )
    table = ranked.groupBy("feature").agg(F.max(gap).alias("ks_statistic"), collect_hits(found).alias("_hits"))
    edges = F.array(*[quantile_from_hits(F.col("_hits"), i) for i in range(bins - 1)])
    return table.select("feature", "ks_statistic", edges.alias("_edges"))


def _psi(counts: DataFrame, edges: DataFrame, floor: float, bins: int) -> DataFrame:
    above = sum((F.get("_edges", F.lit(i)) < F.col("v")).cast("int") for i in range(bins - 1))
    binned = (
        counts.join(F.broadcast(edges), "feature")  # one row per feature: schema-sized
        .withColumn("_bin", above)
        .groupBy("feature", "_bin")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    # At most `bins` rows per feature.
    lane = Window.partitionBy("feature")
    shares = binned.select(
        "feature",
        F.greatest(F.col("a") / F.sum("a").over(lane), F.lit(floor)).alias("p"),
        F.greatest(F.col("b") / F.sum("b").over(lane), F.lit(floor)).alias("q"),
    )
    return shares.groupBy("feature").agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def confidence_shift(df: DataFrame, prob: Column, cohort: str) -> DataFrame:
    """Mean and sample deviation of confidence and entropy per cohort."""
    rows = df.select(F.col(cohort).alias("cohort"), P.confidence(prob).alias("c"), P.entropy(prob).alias("h"))
    return rows.groupBy("cohort").agg(
        F.avg("c").alias("confidence_mean"), F.stddev_samp("c").alias("confidence_std"),
        F.avg("h").alias("entropy_mean"), F.stddev_samp("h").alias("entropy_std"),
    )


def scoring_cohort_summary(
    source: DataFrame, selected: DataFrame, subject: str, date: str, features: Sequence[str],
    groups: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Rows, subjects, duplicates, date and cell coverage, and subject coverage per feature group."""
    per_subject = source.groupBy(subject).agg(F.count("*").alias("n"))
    counts = per_subject.agg(
        F.sum("n").cast("bigint").alias("source_rows"),
        F.count("*").alias("unique_subjects"),
        F.count_if(F.col("n") > 1).alias("duplicate_subjects"),
    )
    have = sum((F.col(c).isNotNull().cast("int") for c in features[1:]), F.col(features[0]).isNotNull().cast("int"))
    cover = selected.agg(
        F.count("*").alias("selected_rows"),
        F.avg(F.col(date).isNotNull().cast("double")).alias("index_date_coverage"),
        F.avg(have / F.lit(float(len(features)))).alias("cell_coverage"),
        *[F.avg(any_available(cols).cast("double")).alias(f"coverage_{g}") for g, cols in groups.items()],
    )
    return counts.withColumns({c: cover.select(c).scalar() for c in cover.columns})


# --- matching ----------------------------------------------------------------------------------


def match_outcomes(
    outcomes: DataFrame,
    index: DataFrame,
    subject: str,
    index_date: str,
    outcome_date: str,
    outcome_label: str,
    scheme: StateScheme = OUTCOME_SCHEME,
    predictions: DataFrame | None = None,
) -> DataFrame:
    """Outcome rows with their index record, months ahead, outcome code and frozen predictions.

    ``index`` and ``predictions`` have one row per subject. Codes: ``included``,
    ``unmatched_subject``, ``missing_date``, ``unresolved_label``.
    """
    known = index.withColumn("_in_index", F.lit(True))
    if predictions is not None:
        known = known.join(predictions, subject, "left")
    matched = lookup_join(outcomes, known, subject, "left")
    state = normalize_state(F.col(outcome_label), scheme)
    ahead = months(F.datediff(outcome_date, index_date))
    code = (
        F.when(F.col("_in_index").isNull(), "unmatched_subject")
        .when(state.isNull(), "unresolved_label")
        .when(ahead.isNull(), "missing_date")
        .otherwise("included")
    )
    return matched.withColumns(
        {
            "outcome_state": state,
            "outcome_label": encode_state(state, scheme),
            "forecast_months": ahead,
            "match_outcome": code,
        }
    ).drop("_in_index")


def replace_from(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join in which the listed columns always take the right-hand value."""
    fresh = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = lookup_join(left, fresh, key, "left")
    kept = [F.col(f"_r_{c}").alias(c) if c in columns else F.col(c) for c in left.columns]
    added = [F.col(f"_r_{c}").alias(c) for c in columns if c not in left.columns]
    return joined.select(*kept, *added)


def concordant_subjects(a: DataFrame, b: DataFrame, subject: str, label: str) -> DataFrame:
    """Subjects of both cohorts with the same label."""
    other = b.select(subject, F.col(label).alias("_other"))
    return a.select(subject, label).join(other, subject).where(F.col(label) == F.col("_other")).select(subject, label)


def concordance_counts(a: DataFrame, b: DataFrame, subject: str, label: str) -> DataFrame:
    other = b.select(subject, F.col(label).alias("_other"))
    same = F.col(label) == F.col("_other")
    return a.select(subject, label).join(other, subject).agg(
        F.count("*").alias("common"), F.count_if(same).alias("concordant"), F.count_if(~same).alias("mismatched")
    )


def follow_up_counts(df: DataFrame, subject: str) -> DataFrame:
    """Mean, median and maximum rows per subject (median from the table of row counts)."""
    from visitline.operators.pairs import weighted_describe

    sizes = df.groupBy(subject).agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return weighted_describe(sizes, F.col("k"), F.col("n")).select(
        F.col("count").alias("subjects"), F.col("mean"), F.col("p50").alias("median"), F.col("max")
    )
