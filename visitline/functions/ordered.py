"""Exact order statistics without a single-task sort.

Every rank, ECDF, AUC and quantile starts from the same step: rows are first collapsed to distinct
values, each value is put in a bucket by a *monotone* expression, bucket totals give the offset of
each bucket, and only the rows of one bucket are ordered inside one task. The borders of value buckets
are sampled splitters: a quantile sketch per group, and per bucket that is still above a row limit,
until none is. A border value is a bucket of its own, so a value that fills many quantiles
doesn't keep its neighbours in one bucket. Borders are fetched or written before they are used, so
that re-running a lost task yields the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from visitline.session import materialize

BUCKET_ROWS = 1 << 16  # a bucket with more rows and more than one value is cut again
CUTS = 256
_BLOCK = 16  # borders are searched in two steps: the block, then the border in it
MAX_POINTS = 4096  # groups and buckets whose borders are fetched; a longer list stays distributed


def seeded_hash(seed: int, *parts: Column) -> Column:
    """The first 60 bits of md5 over ``seed:part:...`` as a number: an order any SQL engine can repeat."""
    text = F.concat_ws(":", F.lit(str(int(seed))), *[p.cast("string") for p in parts])
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("bigint")


def hash_bucket(h: Column) -> Column:
    """Monotone bucket of a 60-bit hash; hashes are uniform, so 4096 buckets are balanced."""
    return F.shiftright(h, 48).cast("int")


def _cut_points(rows: DataFrame, value: str, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Borders of the groups above the limit that hold more than one value; None where no group does."""
    steps = [i / CUTS for i in range(1, CUTS)]
    sketch = rows.groupBy(*keys).agg(
        F.count(value).alias("_rows"), F.min(value).alias("_low"), F.max(value).alias("_high"),
        F.percentile_approx(value, steps, 8 * CUTS).alias("_borders"),
    )
    wide = sketch.where((F.col("_rows") > limit) & (F.col("_low") < F.col("_high")))
    points = wide.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.array_distinct("_borders").alias("_borders"))
    found = points.limit(MAX_POINTS + 1).collect()
    if not found:
        return None
    if len(found) > MAX_POINTS:
        return materialize(points, "borders")
    return F.broadcast(rows.sparkSession.createDataFrame(found, points.schema))


def _cut(df: DataFrame, value: str, keys: Sequence[str], points: DataFrame, bucket: str) -> DataFrame:
    """Every bucket cut at its borders: between two borders, or at one of them."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    v, borders = F.col(value).cast("double"), F.col("_borders")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(borders) - 1) / _BLOCK).cast("int")), lambda i: F.slice(borders, i * _BLOCK + 1, F.lit(_BLOCK)))
    wide = df.join(points.withColumn("_blocks", blocks), same, "left")
    before = F.size(F.filter("_blocks", lambda b: b[0] <= v))  # blocks that begin at or below the value
    block = F.get("_blocks", before - 1)
    upto = F.size(F.filter(block, lambda b: b <= v))
    at = F.when(before == 0, F.lit(0)).otherwise(
        2 * ((before - 1) * _BLOCK + upto) - (F.get(block, upto - 1) == v).cast("int")
    )
    place = F.when(borders.isNull() | v.isNull(), F.lit(0)).otherwise(at)
    moved = wide.withColumn(bucket, F.col(bucket) * F.lit(2 * CUTS) + place.cast("bigint"))
    return moved.drop("_borders", "_blocks", *[f"_key_{k}" for k in keys])


def with_value_bucket(
    df: DataFrame, value: str, by: Sequence[str] = (), bucket: str = "_bucket", rows: DataFrame | None = None, limit: int = BUCKET_ROWS
) -> DataFrame:
    """Add a bucket that is monotone in a numeric column and holds ``limit`` rows at most, or one value.

    ``rows`` is a frame with the columns ``by`` and ``value`` that has every value of ``df`` at least as often,
    if one is cheaper to read. Null values are in the first bucket of their group.
    """
    rows = (df if rows is None else rows).select(*by, F.col(value).cast("double").alias(value))
    placed, rows = (x.withColumn(bucket, F.lit(0).cast("bigint")) for x in (df, rows))
    keys = [*by, bucket]
    while (points := _cut_points(rows, value, keys, limit)) is not None:
        placed, rows = (_cut(x, value, keys, points, bucket) for x in (placed, rows))
    return placed


def running_sums(
    df: DataFrame,
    order: Sequence[str],
    sums: Sequence[str],
    by: Sequence[str] = (),
    bucket: str = "_bucket",
) -> DataFrame:
    """Add ``<c>_before`` (sum over smaller rows of the group) and ``<c>_total`` for each column.

    ``order`` must be unique inside a group and ``bucket`` monotone in it. Rows never meet in one
    task unless they share both group and bucket.
    """
    by = list(by)
    keys = [*by, bucket]
    per_bucket = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    # One row per occupied bucket and group: a bounded frame, ordered inside its group.
    lane = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = lane.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = per_bucket.select(
        *keys,
        *[F.coalesce(F.sum(c).over(ahead), zero).alias(f"_off_{c}") for c in sums],
        *[F.sum(c).over(lane).alias(f"{c}_total") for c in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), zero) for c in sums})
    joined = local.join(offsets, keys)
    return joined.withColumns({f"{c}_before": F.col(f"_in_{c}") + F.col(f"_off_{c}") for c in sums}).drop(
        *[f"_in_{c}" for c in sums], *[f"_off_{c}" for c in sums]
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    weight: str | None = None,
    limit: int = BUCKET_ROWS,
) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per probability.

    Counts of distinct values are ordered with :func:`running_sums`; ``weight`` is an integer
    multiplicity of each row.
    """
    by = list(by)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_value"))
        .agg((F.sum(weight) if weight else F.count("*")).cast("bigint").alias("_n"))
    )
    values = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_value"))
    counted = with_value_bucket(counted, "_value", by, rows=values, limit=limit)
    ranked = running_sums(counted, ["_value"], ["_n"], by)
    found = quantile_hits(F.col("_value"), F.col("_n_before"), F.col("_n"), F.col("_n_total"), probs)
    return ranked.groupBy(*by).agg(collect_hits(found).alias("_hits")).select(
        *by, *[quantile_from_hits(F.col("_hits"), i).alias(name) for i, name in enumerate(names)]
    )


# Ranks of this sketch are off by a row in MEDIAN_ACCURACY at most; its borders are taken twice that far from the middle.
MEDIAN_ACCURACY = 10000


def median_sketch(value: Column) -> Column:
    """Two values between which, both included, the middle rows of a column are."""
    return F.percentile_approx(value, [0.5 - 2 / MEDIAN_ACCURACY, 0.5 + 2 / MEDIAN_ACCURACY], MEDIAN_ACCURACY)


def exact_medians(df: DataFrame, brackets: dict[str, Sequence[float]]) -> dict[str, float]:
    """The interpolated median of each numeric column, all of them found in two scans.

    ``brackets`` has the borders from :func:`median_sketch`. Only the rows between them, a small share
    beside ties, are shuffled and ordered; those below are counted. Where the borders turn out not to hold the
    middle rows, all rows are ordered.
    """
    if not brackets:
        return {}
    names = list(brackets)
    value = {c: F.col(c).cast("double") for c in names}
    aggs = []
    for i, c in enumerate(names):
        v, (low, high) = F.when(~F.isnan(value[c]), value[c]), (F.lit(float(x)) for x in brackets[c])
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v < low).alias(f"b{i}"), F.count_if((v >= low) & (v <= high)).alias(f"i{i}")]
    counts = df.agg(*aggs).first()
    offsets, inside, kept = {}, [], F.lit(False)
    for i, c in enumerate(names):
        n, before, held = counts[f"n{i}"], counts[f"b{i}"], counts[f"i{i}"]
        keep = value[c].isNotNull() & ~F.isnan(value[c])
        if before <= (n - 1) // 2 and n // 2 < before + held:
            keep = keep & value[c].between(*[F.lit(float(x)) for x in brackets[c]])
        else:
            before = 0
        offsets[c] = (n, before)
        kept = kept | keep
        inside.append(F.when(keep, F.struct(F.lit(c).alias("_column"), value[c].alias("_value"))))
    # Plain comparisons decide first: the array work runs for the few rows that hold a value between borders.
    rows = df.where(kept).select(F.inline(F.array_compact(F.array(*inside))))
    counted = rows.groupBy("_column", "_value").agg(F.count("*").alias("_n"))
    ranked = running_sums(with_value_bucket(counted, "_value", ["_column"], rows=rows), ["_value"], ["_n"], ["_column"])
    place = lambda at: reduce(lambda out, c: out.when(F.col("_column") == c, F.lit(at(*offsets[c]))), names, F.when(F.lit(False), F.lit(0)))
    holds = lambda at: (F.col("_n_before") <= place(at)) & (place(at) < F.col("_n_before") + F.col("_n"))
    lower, upper = (lambda n, before: (n - 1) // 2 - before), (lambda n, before: n // 2 - before)
    middle = ranked.groupBy("_column").agg(
        F.max(F.when(holds(lower), F.col("_value"))).alias("low"), F.max(F.when(holds(upper), F.col("_value"))).alias("high")
    )
    part = {c: 0.0 if offsets[c][0] % 2 else 0.5 for c in names}
    return {r["_column"]: r["low"] + (r["high"] - r["low"]) * part[r["_column"]] for r in middle.collect()}


def quantile_hits(value: Column, before: Column, n: Column, total: Column, probs: Sequence[float]) -> Column:
    """The quantiles whose lower or upper neighbour is this row, or null for nearly every row."""
    first, last = before, before + n - 1

    def place(p: Column, i: Column) -> Column:
        at = (total - 1) * p
        low, high = F.floor(at), F.ceil(at)
        return F.struct(
            i.alias("q"),
            F.when((first <= low) & (low <= last), value).alias("low"),
            F.when((first <= high) & (high <= last), value).alias("high"),
            (at - low).alias("part"),
        )

    places = F.transform(F.array(*[F.lit(float(p)) for p in probs]), place)
    hits = F.filter(places, lambda h: h["low"].isNotNull() | h["high"].isNotNull())
    # Plain comparisons decide first: the array work above runs for the few rows that hold a quantile.
    held = F.lit(False)
    for p in probs:
        at = (total - 1) * F.lit(float(p))
        held = held | ((first <= F.ceil(at)) & (F.floor(at) <= last))
    return F.when(held, hits)


def collect_hits(hits: Column) -> Column:
    """All hits of a group: at most two per quantile, whatever the group's size."""
    return F.flatten(F.collect_list(hits))


def quantile_from_hits(hits: Column, i: int) -> Column:
    own = F.filter(hits, lambda h: h["q"] == i)
    low = F.array_max(F.transform(own, lambda h: h["low"]))
    high = F.array_max(F.transform(own, lambda h: h["high"]))
    return low + (high - low) * F.array_max(F.transform(own, lambda h: h["part"]))
