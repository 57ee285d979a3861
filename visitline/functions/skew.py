"""Joins that stay balanced when one key holds a large share of the rows.

A key is hot when it owns more than ``min_rows`` rows, whatever its share of the table. Up to
``MAX_HOT`` such keys are fetched and broadcast; a longer list stays a distributed frame. When no key
is hot the join is a plain one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

MAX_HOT = 4096
MIN_HOT_ROWS = 500_000


def hot_keys(counts: DataFrame, keys: Sequence[str], rows: str, min_rows: int = MIN_HOT_ROWS) -> DataFrame | None:
    """Keys of a per-key count table that need splitting, with ``_splits`` parts each, or None."""
    parts = counts.where(F.col(rows) > min_rows).select(*keys, F.ceil(F.col(rows) / F.lit(min_rows)).cast("bigint").alias("_splits"))
    found = parts.limit(MAX_HOT + 1).collect()
    if not found:
        return None
    if len(found) > MAX_HOT:
        return parts
    return F.broadcast(counts.sparkSession.createDataFrame(found, parts.schema))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    spread: Column,
    counts: DataFrame | None = None,
    rows: str = "_rows",
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """``left`` join ``right`` on ``keys`` with the hot keys of ``left`` spread over parts.

    Rows of a hot key are dealt to parts by ``spread``; only the matching rows of ``right`` are
    repeated per part. ``counts`` may pass a cheaper row count per key of ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    keys = list(keys)
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count("*").alias(rows))
    hot = hot_keys(counts, keys, rows, min_rows)
    if hot is None:
        return left.join(right, keys, how)
    parts = F.coalesce(F.col("_splits"), F.lit(1).cast("bigint"))
    dealt = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts)).drop("_splits")
    copies = (
        right.join(hot, keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
        .drop("_splits")
    )
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Rows joined to a table with one row per ``key``; a key that owns many rows is split."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    return salted_join(
        rows, lookup, [key], how, F.struct(*[F.col(c) for c in rows.columns]), counts=counts, min_rows=min_rows
    )
