"""Checks that end in rows, not exceptions, plus the asserting forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from visitline.functions import probability as P
from visitline.operators.splits import overlapping_subjects

# Target columns that must never be used as source features.
TARGET_COLUMNS = ("target_state", "label", "future_date")


def check(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    """One named check as a one-row frame; ``passed`` and ``detail`` are aggregates over ``df``."""
    return df.agg(F.coalesce(passed, F.lit(True)).alias("passed"), detail.cast("string").alias("detail")).select(
        F.lit(name).alias("name"), "passed", "detail"
    )


def gate(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks, followed by the ``overall`` row."""
    union = checks[0]
    for c in checks[1:]:
        union = union.unionByName(c)
    total = union.agg(F.every("passed").alias("passed"), F.count("*").cast("string").alias("detail"))
    return union.unionByName(total.select(F.lit("overall").alias("name"), "passed", "detail"))


def pair_integrity(pairs: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """Subjects stay in one split, sources precede targets, no target column is a feature."""
    crossing = overlapping_subjects(pairs, "subject", split)
    forbidden = sorted(set(TARGET_COLUMNS) & set(features))
    late = F.count_if(F.col("source_date") >= F.col("future_date"))
    return gate(
        [
            check(crossing, "subjects_in_one_split", F.count("*") == 0, F.count("*")),
            check(pairs, "source_before_target", late == 0, late),
            check(pairs.limit(1), "no_target_in_features", F.lit(not forbidden), F.lit(",".join(forbidden))),
        ]
    )


def assert_pair_integrity(pairs: DataFrame, features: Sequence[str], split: str = "split") -> None:
    failed = [r["name"] for r in pair_integrity(pairs, features, split).where(~F.col("passed")).collect()]
    if failed:
        raise AssertionError(f"Pair integrity failed: {', '.join(failed)}")


def simplex_check(df: DataFrame, prob: Column, tolerance: float = 1e-8) -> DataFrame:
    worst = F.max(P.off_simplex(prob))
    return check(df, "probability_simplex", worst <= tolerance, F.count("*"))


def assert_simplex(df: DataFrame, prob: Column, tolerance: float = 1e-8) -> None:
    if not simplex_check(df, prob, tolerance).first()["passed"]:
        raise ValueError("Probability rows do not sum to one.")


def reproduced(
    stored: DataFrame, fresh: DataFrame, key: Sequence[str], columns: Sequence[str], tolerance: float = 1e-12
) -> DataFrame:
    """Are two scorings of the same rows equal within ``tolerance``? Unmatched rows fail."""
    other = fresh.select(*key, *[F.col(c).alias(f"_f_{c}") for c in columns], F.lit(1).alias("_there"))
    joined = stored.select(*key, *columns, F.lit(1).alias("_here")).join(other, list(key), "full")
    gaps = [F.abs(F.col(c) - F.col(f"_f_{c}")) for c in columns]
    worst = F.max(F.greatest(*gaps) if len(gaps) > 1 else gaps[0])
    unmatched = F.count_if(F.col("_here").isNull() | F.col("_there").isNull())
    return joined.agg(
        F.count("*").alias("rows"), unmatched.alias("unmatched"), worst.alias("max_gap")
    ).withColumn("reproduced", (F.col("unmatched") == 0) & (F.coalesce("max_gap", F.lit(0.0)) <= tolerance))
