"""Within-subject (earlier visit, later visit) pairs and everything counted over them.

The pair table is a band self-join on ``(subject, time bucket)``: a bucket is as wide as the
longest horizon, so a source visit only meets visits of its own and the next bucket and a subject
with a very long history is spread over many keys. Counts over pairs never build the pairs: they
come from prefix sums over visits, which is linear in the number of visits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from visitline.functions.dates import day_band, instant, is_calendar_date, months, ticks_per_day, whole_days
from visitline.functions.ordered import running_sums
from visitline.functions.skew import MIN_HOT_ROWS, salted_join
from visitline.functions.states import DEFAULT_SCHEME, StateScheme, encode_state, normalize_state, transition
from visitline.operators.selection import require_columns


def _prepared(df, subject, date, label, row_id, scheme, features=(), require_state=True):
    require_columns(df, [subject, date, label, row_id, *features])
    visits = df.select(
        F.col(subject).alias("subject"),
        F.col(date).alias("visit_date"),
        instant(df, date).alias("at"),
        F.col(row_id).alias("row_id"),
        normalize_state(F.col(label), scheme).alias("state"),
        *features,
    ).where(F.col("subject").isNotNull() & F.col("at").isNotNull())
    return visits.where(F.col("state").isNotNull()) if require_state else visits


def future_pairs(
    df: DataFrame,
    features: Sequence[str],
    subject: str,
    date: str,
    label: str,
    row_id: str,
    min_months: float = 6,
    max_months: float = 60,
    scheme: StateScheme = DEFAULT_SCHEME,
    carry: Sequence[str] = (),
    hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Every in-band (source, later) pair with source features and the later state as target.

    The source state may be unknown. ``carry`` passes extra source columns (such as ``split``).
    """
    visits = _prepared(df, subject, date, label, row_id, scheme, [*features, *carry], require_state=False)
    return _band_join(
        visits, visits, visits.where(F.col("state").isNotNull()), df, date, features, carry, min_months, max_months, scheme, hot_rows
    )


def _band_join(base, sources, futures, df, date, features, carry, min_months, max_months, scheme, hot_rows):
    ticks = ticks_per_day(df, date)
    low, high = day_band(min_months, max_months)
    width = (high + 1) * ticks
    slot = F.floor(F.col("at") / F.lit(width)).cast("bigint")
    left = sources.withColumn("slot", slot).withColumnsRenamed(
        {"visit_date": "source_date", "at": "source_at", "row_id": "source_row", "state": "source_state"}
    )
    right = futures.select(
        "subject",
        F.explode(F.array(slot - 1, slot)).alias("slot"),
        F.col("visit_date").alias("future_date"),
        F.col("at").alias("future_at"),
        F.col("row_id").alias("future_row"),
        F.col("state").alias("target_state"),
    )
    gap = whole_days(F.col("source_at"), F.col("future_at"), ticks)
    later = (F.col("future_at") > F.col("source_at")) | (
        (F.col("future_at") == F.col("source_at")) & (F.col("future_row") > F.col("source_row"))
    )
    per_slot = base.groupBy("subject", slot.alias("slot")).agg(F.count("*").alias("_rows"))
    joined = salted_join(
        left, right, ["subject", "slot"], "inner", F.col("source_row"), counts=per_slot, min_rows=hot_rows
    )
    day = "yyyy-MM-dd"
    return joined.where(later & gap.between(low, high)).select(
        "subject",
        F.date_format("source_date", day).alias("source_date"),
        F.date_format("future_date", day).alias("future_date"),
        "source_row",
        "future_row",
        months(gap).alias("forecast_months"),
        "source_state",
        "target_state",
        encode_state(F.col("target_state"), scheme).alias("label"),
        *features,
        *carry,
    )


def pair_counts_per_visit(
    df: DataFrame,
    subject: str,
    date: str,
    label: str,
    row_id: str,
    min_months: float = 6,
    max_months: float = 60,
    scheme: StateScheme = DEFAULT_SCHEME,
    carry: Sequence[str] = (),
    require_state: bool = True,
) -> DataFrame:
    """Per (subject, visit instant, source state): how many in-band pairs lead to each state.

    Columns ``to_<state>`` count pairs summed over the ``visits`` source rows of that instant.
    Needs ``min_months > 0`` or dates without same-instant visits, as ties have no order here.
    Visits and the two band ends of every source are merged into one ordered stream per subject;
    a running count read at the band ends gives the counts.
    """
    visits = _prepared(df, subject, date, label, row_id, scheme, carry, require_state)
    ticks = ticks_per_day(df, date)
    low, high = day_band(min_months, max_months)
    if low <= 0:
        raise ValueError("pair counts need a positive minimum horizon")
    states = list(scheme.states)
    group = ["subject", *carry]
    daily = visits.groupBy(*group, "at", "state").agg(F.count("*").alias("visits"))
    arrive = [
        F.when(F.col("state") == s, F.col("visits")).otherwise(F.lit(0)).cast("bigint").alias(f"n_{s}") for s in states
    ]
    # kind 0 reads come before arrivals (1) of the same instant: both band ends are exclusive.
    stream = daily.withColumn(
        "event",
        F.explode(
            F.array(
                F.struct(F.col("at").alias("t"), F.lit(1).alias("kind")),
                F.struct((F.col("at") + F.lit(low * ticks)).alias("t"), F.lit(-1).alias("kind")),
                F.struct((F.col("at") + F.lit((high + 1) * ticks)).alias("t"), F.lit(0).alias("kind")),
            )
        ),
    )
    is_visit = F.col("event.kind") == 1
    stream = stream.select(
        *group,
        F.col("event.t").alias("t"),
        F.col("event.kind").alias("kind"),
        "at",
        "state",
        "visits",
        *[F.when(is_visit, a).otherwise(F.lit(0)).cast("bigint").alias(f"n_{s}") for a, s in zip(arrive, states)],
    )
    order = [F.col("t"), F.col("kind"), F.col("at"), F.col("state")]
    if is_calendar_date(df, date):
        # A subject has at most (distinct days x states x 3) rows here, whatever its visit count.
        lane = Window.partitionBy("subject").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        read = stream.withColumns({f"n_{s}_before": F.coalesce(F.sum(f"n_{s}").over(lane), F.lit(0)) for s in states})
    else:
        slots = stream.withColumn("_bucket", F.floor(F.col("t") / F.lit(90 * ticks)).cast("bigint"))
        read = running_sums(slots, ["t", "kind", "at", "state"], [f"n_{s}" for s in states], ["subject"])
    reads = read.where(F.col("kind") <= 0)
    sign = F.when(F.col("kind") == 0, F.lit(1)).otherwise(F.lit(-1))
    return (
        reads.groupBy(*group, "at", "state")
        .agg(
            F.max("visits").alias("visits"),
            *[F.sum(sign * F.col(f"n_{s}_before") * F.col("visits")).cast("bigint").alias(f"to_{s}") for s in states],
        )
        .withColumnRenamed("state", "source_state")
    )


def pairs_per_subject(counts: DataFrame, scheme: StateScheme = DEFAULT_SCHEME) -> DataFrame:
    """Pairs and source visits per subject from :func:`pair_counts_per_visit`."""
    all_pairs = sum((F.col(f"to_{s}") for s in scheme.states[1:]), F.col(f"to_{scheme.states[0]}"))
    return counts.groupBy("subject").agg(F.sum(all_pairs).alias("pairs"), F.sum("visits").alias("visits"))


def transition_pairs(
    df: DataFrame,
    features: Sequence[str],
    subject: str,
    date: str,
    label: str,
    row_id: str,
    min_months: float = 6,
    max_months: float = 60,
    scheme: StateScheme = DEFAULT_SCHEME,
    carry: Sequence[str] = (),
    hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Pairs with both states known, their transition and a weight that sums to 1 per subject.

    The weight is joined to the visits before they are paired, so the pair table itself is never
    shuffled again. Bands that start at 0 also pair visits of one instant, in row order; their pairs are
    counted by building them once.
    """
    visits = _prepared(df, subject, date, label, row_id, scheme, [*features, *carry])
    if day_band(min_months, max_months)[0] > 0:
        counts = pair_counts_per_visit(df, subject, date, label, row_id, min_months, max_months, scheme)
        per_subject = pairs_per_subject(counts, scheme).where(F.col("pairs") > 0)
    else:
        bare = visits.drop(*features, *carry)
        built = _band_join(bare, bare, bare, df, date, [], [], min_months, max_months, scheme, hot_rows)
        per_subject = built.groupBy("subject").agg(F.count("*").alias("pairs"))
    weights = per_subject.select("subject", (F.lit(1.0) / F.col("pairs")).alias("subject_weight"))
    sources = salted_join(
        visits, weights, ["subject"], "inner", F.col("row_id"),
        counts=visits.groupBy("subject").agg(F.count("*").alias("_rows")), min_rows=hot_rows,
    )
    pairs = _band_join(
        visits, sources, visits.drop(*features, *carry), df, date, features, [*carry, "subject_weight"],
        min_months, max_months, scheme, hot_rows,
    )
    return (
        pairs.withColumnRenamed("target_state", "future_state")
        .withColumn("transition", transition(F.col("source_state"), F.col("future_state")))
    )


def attach_split(df: DataFrame, assignment: DataFrame, subject: str, drop_excluded: bool = True) -> DataFrame:
    """Split of each row's subject, compared as text; subjects without one are ``excluded``."""
    lookup = assignment.select(F.col("subject").cast("string").alias("_key"), "split")
    key = F.col(subject).cast("string").alias("_key")
    tagged = (
        salted_join(
            df.select("*", key), lookup, ["_key"], "left", F.struct(*[F.col(c) for c in df.columns]),
            counts=df.groupBy(key).agg(F.count("*").alias("_rows")),
        )
        .withColumn("split", F.coalesce("split", F.lit("excluded")))
        .drop("_key")
    )
    return tagged.where(F.col("split") != "excluded") if drop_excluded else tagged


def transition_matrix(counts: DataFrame, scheme: StateScheme = DEFAULT_SCHEME, by: Sequence[str] = ()) -> DataFrame:
    """Pair count by (group, source state, future state); empty cells are left out."""
    cells = counts.groupBy(*by, "source_state").agg(*[F.sum(f"to_{s}").alias(s) for s in scheme.states])
    return cells.unpivot([*by, "source_state"], list(scheme.states), "future_state", "count").where(F.col("count") > 0)


def gap_histogram(
    df: DataFrame, subject: str, date: str, label: str, row_id: str, min_months: float = 6, max_months: float = 60,
    scheme: StateScheme = DEFAULT_SCHEME, hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Number of transition pairs per whole-day gap, from visits collapsed per subject and instant.

    The band bounds the result: one row per possible gap.
    """
    visits = _prepared(df, subject, date, label, row_id, scheme)
    ticks = ticks_per_day(df, date)
    low, high = day_band(min_months, max_months)
    slot = F.floor(F.col("at") / F.lit((high + 1) * ticks)).cast("bigint")
    daily = visits.groupBy("subject", "at").agg(F.count("*").alias("n")).withColumn("slot", slot)
    later = daily.select(
        "subject", F.explode(F.array(F.col("slot") - 1, F.col("slot"))).alias("slot"),
        F.col("at").alias("later_at"), F.col("n").alias("later_n"),
    )
    gap = whole_days(F.col("at"), F.col("later_at"), ticks)
    return (
        salted_join(
            daily, later, ["subject", "slot"], "inner", F.col("at"), min_rows=hot_rows,
            counts=visits.groupBy("subject", slot.alias("slot")).agg(F.count_distinct("at").alias("_rows")),
        )
        .where((F.col("later_at") > F.col("at")) & gap.between(low, high))
        .groupBy(gap.alias("days"))
        .agg(F.sum(F.col("n") * F.col("later_n")).cast("bigint").alias("pairs"))
    )


def weighted_describe(df: DataFrame, value: Column, weight: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """count / mean / sample std / min / quartiles / max of a small value-count table.

    ``df`` has one row per distinct value (of a count or a day gap), which bounds the one ordered
    window used here. ``extra`` are further aggregates over ``df``.
    """
    rows = df.select("*", value.cast("double").alias("v"), weight.cast("bigint").alias("w"))
    every = Window.partitionBy(F.lit(0))
    ahead = every.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    cum = rows.withColumns(
        {
            "_before": F.coalesce(F.sum("w").over(ahead), F.lit(0)),
            "_n": F.sum("w").over(every),
            "_m": F.sum(F.col("v") * F.col("w")).over(every) / F.sum("w").over(every),
        }
    )

    def at(pos):
        return F.max(F.when((F.col("_before") <= pos) & (pos < F.col("_before") + F.col("w")), F.col("v")))

    def quantile(p):
        place = (F.col("_n") - 1) * F.lit(p)
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        return low + (high - low) * part

    spread = F.sum(F.col("w") * F.pow(F.col("v") - F.col("_m"), F.lit(2.0)))
    return cum.agg(
        F.sum("w").alias("count"),
        F.max("_m").alias("mean"),
        F.when(F.sum("w") > 1, F.sqrt(spread / (F.sum("w") - 1))).alias("std"),
        F.min("v").alias("min"),
        *[quantile(p).alias(name) for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))],
        F.max("v").alias("max"),
        *extra,
    )


def pair_statistics(counts: DataFrame, scheme: StateScheme = DEFAULT_SCHEME, pairs: DataFrame | None = None) -> DataFrame:
    """One row: subjects, pairs, median / max pairs per subject, weight sums, target distribution.

    Weight sums are those of the weights attached to ``pairs`` (from :func:`transition_pairs`), null without it.
    """
    to = [F.col(f"to_{s}") for s in scheme.states]
    per_subject = counts.groupBy("subject").agg(
        F.sum(sum(to[1:], to[0])).alias("pairs"), *[F.sum(c).alias(f"to_{s}") for c, s in zip(to, scheme.states)]
    )
    if pairs is None:
        weighed = per_subject.withColumn("weight", F.lit(None).cast("double"))
    else:
        sums = pairs.groupBy("subject").agg(F.sum("subject_weight").alias("weight"))
        weighed = per_subject.join(sums, "subject", "left")
    # Subjects per pair count: a short table that carries the median exactly.
    sizes = (
        weighed.where(F.col("pairs") > 0)
        .groupBy("pairs")
        .agg(
            F.count("*").alias("subjects"), *[F.sum(f"to_{s}").alias(f"to_{s}") for s in scheme.states],
            F.sum("weight").alias("weights"), F.min("weight").alias("lowest"), F.max("weight").alias("highest"),
        )
    )
    totals = [F.sum(F.col("pairs") * F.col("subjects")).cast("bigint").alias("total_pairs")]
    totals += [F.sum(f"to_{s}").cast("bigint").alias(f"future_{s}") for s in scheme.states]
    totals += [F.sum("weights").alias("weights"), F.min("lowest").alias("lowest_sum"), F.max("highest").alias("highest_sum")]
    return weighted_describe(sizes, F.col("pairs"), F.col("subjects"), totals).select(
        F.col("count").cast("bigint").alias("subjects"),
        "total_pairs",
        F.col("p50").alias("median_pairs_per_subject"),
        F.col("max").cast("bigint").alias("maximum_pairs_per_subject"),
        F.col("weights").alias("effective_weighted_sample_size"),
        F.col("lowest_sum").alias("per_subject_weight_sum_min"),
        F.col("highest_sum").alias("per_subject_weight_sum_max"),
        *[f"future_{s}" for s in scheme.states],
    )


def pair_summary_by_split(counts: DataFrame, scheme: StateScheme = DEFAULT_SCHEME) -> DataFrame:
    """Subjects, pairs, mean pairs per subject and target counts per split.

    ``counts`` comes from :func:`pair_counts_per_visit` with ``carry=["split"]``.
    """
    to = [F.col(f"to_{s}") for s in scheme.states]
    all_pairs = sum(to[1:], to[0])
    per_subject = counts.groupBy("split", "subject").agg(
        F.sum(all_pairs).alias("pairs"), *[F.sum(f"to_{s}").alias(f"to_{s}") for s in scheme.states]
    )
    return (
        per_subject.where(F.col("pairs") > 0)
        .groupBy("split")
        .agg(
            F.count("*").alias("subjects"),
            F.sum("pairs").cast("bigint").alias("pairs"),
            F.avg("pairs").alias("pairs_per_subject_mean"),
            *[F.sum(f"to_{s}").cast("bigint").alias(f"target_{s}") for s in scheme.states],
        )
    )
