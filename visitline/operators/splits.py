"""Subject splits without leakage, folds, fingerprints and resampling.

No split orders all subjects in one task: ranks come from bucket totals plus a rank inside a small
bucket (see :mod:`visitline.functions.ordered`), and hash order replaces random shuffling.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from visitline.functions.ordered import hash_bucket, running_sums, seeded_hash
from visitline.functions.skew import salted_join
from visitline.operators.selection import first_per_key  # noqa: F401  (re-exported for callers)
from visitline.session import materialize, ship_package


ID_CHARACTERS = 3  # of an id, past the shared ones, that part the subjects of one instant


def subject_labels(df: DataFrame, subject: str, label: str) -> DataFrame:
    """Most frequent label per subject, the smallest one on ties."""
    return df.groupBy(F.col(subject).alias("subject")).agg(F.mode(label, deterministic=True).alias("label"))


def temporal_split(
    df: DataFrame,
    subject: str,
    date: str,
    train_fraction: float = 0.70,
    validation_fraction: float = 0.15,
) -> DataFrame:
    """Subjects by first date: earliest ``int(n*train)``, next ``int(n*validation)``, rest.

    Ties are ordered by id as text. Subjects are counted per calendar day (a short table) to find
    the day of each cut; only subjects of those days are ranked. Their buckets are the instant and the
    first characters in which the day's ids differ, which is monotone in (instant, id).
    """
    first = (
        df.where(F.col(subject).isNotNull())
        .groupBy(F.col(subject).alias("subject"))
        .agg(F.min(date).alias("index_date"))
        .where(F.col("index_date").isNotNull())
        .withColumns({"_day": F.to_date("index_date"), "_id": F.col("subject").cast("string")})
    )
    days = first.groupBy("_day").agg(F.count("*").alias("_n"))
    lane = Window.partitionBy(F.lit(0))
    upto = lane.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns(
        {"_before": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_all": F.sum("_n").over(lane)}
    ).withColumns(
        {"_train_end": F.floor(F.col("_all") * F.lit(train_fraction)).cast("bigint")}
    ).withColumn(
        "_validation_end", F.col("_train_end") + F.floor(F.col("_all") * F.lit(validation_fraction)).cast("bigint")
    )
    cut_here = lambda end: (F.col("_before") < F.col(end)) & (F.col(end) < F.col("_before") + F.col("_n"))
    # One row per calendar day, however many subjects there are.
    placed = first.join(F.broadcast(days), "_day").withColumn(
        "_cut", cut_here("_train_end") | cut_here("_validation_end")
    )
    whole = placed.where(~F.col("_cut")).withColumn("_rank", F.col("_before"))
    in_cut_day = placed.where(F.col("_cut"))
    # How many characters all ids of a day share: one row per cut day.
    ends = in_cut_day.groupBy("_day").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
    shared = F.expr(
        "size(filter(sequence(1, greatest(1, least(length(_lo), length(_hi)))), i -> left(_lo, i) = left(_hi, i)))"
    )
    split_days = in_cut_day.join(F.broadcast(ends.select("_day", shared.alias("_shared"))), "_day").withColumns(
        {
            "_bucket": F.struct("index_date", F.left("_id", F.col("_shared") + ID_CHARACTERS).alias("id")),
            "_one": F.lit(1).cast("bigint"),
        }
    )
    ranked = running_sums(split_days, ["index_date", "_id"], ["_one"], ["_day"]).withColumn(
        "_rank", F.col("_before") + F.col("_one_before")
    )
    keep = ["subject", "index_date", "_rank", "_train_end", "_validation_end"]
    return whole.select(*keep).unionByName(ranked.select(*keep)).select(
        "subject",
        "index_date",
        F.when(F.col("_rank") < F.col("_train_end"), "train")
        .when(F.col("_rank") < F.col("_validation_end"), "validation")
        .otherwise("temporal_test")
        .alias("split"),
    )


def hash_ranked(subjects: DataFrame, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Add ``position`` (0-based place in seeded hash order within the group) and ``size``."""
    hashed = subjects.withColumn("_hash", seeded_hash(seed, F.col("subject"))).withColumns(
        {"_bucket": hash_bucket(F.col("_hash")), "_one": F.lit(1).cast("bigint")}
    )
    return (
        running_sums(hashed, ["_hash", "subject"], ["_one"], by)
        .withColumnsRenamed({"_one_before": "position", "_one_total": "size"})
        .drop("_hash", "_bucket", "_one")
    )


def random_split(
    df: DataFrame, subject: str, seed: int = 42, val_size: float = 0.10, test_size: float = 0.20
) -> DataFrame:
    """Subjects cut at exact sizes in seeded hash order: test, then validation of the remainder."""
    subjects = df.select(F.col(subject).alias("subject")).where(F.col("subject").isNotNull()).distinct()
    ranked = hash_ranked(subjects, seed)
    n_test = F.ceil(F.col("size") * F.lit(test_size))
    n_val = F.ceil((F.col("size") - n_test) * F.lit(val_size / (1.0 - test_size)))
    return ranked.select(
        "subject",
        F.when(F.col("position") < n_test, "test")
        .when(F.col("position") < n_test + n_val, "val")
        .otherwise("train")
        .alias("split"),
    )


def allocate_strata(counts: Mapping, take: int) -> dict | None:
    """Per-stratum share of ``take`` rows: proportional floors, then largest remainders.

    None (no stratification) when a stratum is too small to be split.
    """
    n = sum(counts.values())
    if min(counts.values()) < 2 or take < len(counts) or n - take < len(counts):
        return None
    exact = {k: take * c / n for k, c in counts.items()}
    shares = {k: math.floor(x) for k, x in exact.items()}
    for k in sorted(counts, key=lambda k: (-(exact[k] - shares[k]), str(k)))[: take - sum(shares.values())]:
        shares[k] += 1
    return shares


def stratified_split(
    df: DataFrame, subject: str, label: str, seed: int, test_size: float = 0.20, val_size: float = 0.10
) -> DataFrame:
    """Subject split stratified on the subject's most frequent label.

    Subjects without any label are a stratum of their own. Only the per-label subject counts reach the driver. Inside a label, subjects are ranked in
    seeded hash order; sizes are exact and the same for every seed.
    """
    # A struct around the label joins where the label itself is null.
    # Written once: the counts and both sides of the ranking read it.
    subjects = materialize(subject_labels(df, subject, label), "subject-labels").withColumn("_stratum", F.struct("label"))
    counts = {r["label"]: r["n"] for r in subjects.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    n_test = math.ceil(n * test_size)
    test = allocate_strata(counts, n_test)
    n_val = math.ceil((n - n_test) * (val_size / (1.0 - test_size)))
    cut_test = test
    rest = {k: counts[k] - test[k] for k in counts} if test is not None else None
    val = allocate_strata(rest, n_val) if rest and min(rest.values()) > 0 else None
    if cut_test is None or val is None:
        ranked = hash_ranked(subjects, seed)
        test_end, val_end = F.lit(n_test), F.lit(n_test + n_val)
        if cut_test is not None:
            # Stratified test, plain validation: order test subjects first, then the rest.
            ranked = hash_ranked(subjects, seed, ["_stratum"])
            in_test = F.col("position") < _by_label(cut_test)
            chosen = ranked.select("subject", "label", in_test.alias("in_test"))
            remainder = hash_ranked(chosen.where(~F.col("in_test")).select("subject", "label"), seed + 1)
            return chosen.where("in_test").select("subject", "label", F.lit("test").alias("split")).unionByName(
                remainder.select(
                    "subject", "label", F.when(F.col("position") < n_val, "val").otherwise("train").alias("split")
                )
            )
    else:
        ranked = hash_ranked(subjects, seed, ["_stratum"])
        test_end = _by_label(test)
        val_end = _by_label({k: test[k] + val[k] for k in counts})
    return ranked.select(
        "subject",
        "label",
        F.when(F.col("position") < test_end, "test")
        .when(F.col("position") < val_end, "val")
        .otherwise("train")
        .alias("split"),
    )


def _by_label(values: Mapping) -> Column:
    """Lookup of a per-label number for the handful of labels of a task."""
    picked = F.lit(None).cast("bigint")
    for key, value in values.items():
        picked = F.when(F.col("label").eqNullSafe(F.lit(key)), F.lit(value)).otherwise(picked)
    return picked


def lightest_folds(loads: Sequence[int], rows: int, subjects: int) -> list[int]:
    """How many of ``subjects`` subjects of ``rows`` rows each fold gets if each goes to the fold with fewest rows.

    Those are the ``subjects`` smallest of the loads at which a fold would take its next one (the first fold on
    ties), found by a search for the load they all stay below: no step per subject.
    """
    taken = lambda level: [max(0, (level - load) // rows + 1) for load in loads]
    low, high = min(loads) - 1, max(loads) + rows * subjects
    while low < high:
        level = (low + high + 1) // 2
        low, high = (level, high) if sum(taken(level)) <= subjects else (low, level - 1)
    got = taken(low)
    left = subjects - sum(got)
    for fold, load in enumerate(loads):
        if left and load <= low + 1 and (low + 1 - load) % rows == 0:
            got[fold] += 1
            left -= 1
    return got


def _deal(sizes: pd.DataFrame, n_splits: int) -> pd.DataFrame:
    loads, dealt = [0] * n_splits, []
    ordered = sizes.sort_values("rows", ascending=False)
    for rows, subjects in zip(ordered["rows"].tolist(), ordered["subjects"].tolist()):
        got = lightest_folds(loads, rows, subjects)
        loads = [load + rows * n for load, n in zip(loads, got)]
        dealt.append((rows, list(itertools.accumulate(got))))
    return pd.DataFrame(dealt, columns=["rows", "bounds"])


def grouped_folds(df: DataFrame, subject: str, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Fold per subject, balanced by rows: the largest subjects first, each to the fold with fewest rows.

    Folds differ by at most the rows of the largest subject. One task deals the table of distinct sizes, of which
    n rows make at most sqrt(2n); subjects of one size are cut in seeded hash order. Rows without a subject are
    one subject. Sizes are written once (``session.release`` deletes them).
    """
    sizes = materialize(df.groupBy(F.col(subject).alias("subject")).agg(F.count("*").alias("rows")), "fold-sizes")
    ship_package(df.sparkSession)
    table = sizes.groupBy("rows").agg(F.count("*").alias("subjects"))
    bounds = table.groupBy().applyInPandas(lambda x: _deal(x, n_splits), "rows long, bounds array<long>")
    ranked = hash_ranked(sizes, seed, ["rows"])
    folds = salted_join(ranked, bounds, ["rows"], "inner", F.col("subject"), counts=table, rows="subjects")
    passed = F.size(F.filter("bounds", lambda b: b <= F.col("position")))
    out = folds.select("subject", "rows", (passed + 1).cast("int").alias("fold"))
    out._visitline_folder = sizes._visitline_folder
    return out


def overlapping_subjects(assignment: DataFrame, subject: str = "subject", split: str = "split") -> DataFrame:
    """Subjects found in more than one split (empty when the splits are disjoint)."""
    return (
        assignment.select(subject, split)
        .distinct()
        .groupBy(subject)
        .agg(F.count("*").alias("n_splits"))
        .where(F.col("n_splits") > 1)
    )


def assert_disjoint(assignment: DataFrame, subject: str = "subject", split: str = "split") -> None:
    if overlapping_subjects(assignment, subject, split).limit(1).count():
        raise AssertionError("A subject appears in more than one split.")


def cut_dates(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("split").agg(
        F.date_format(F.min("index_date"), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max("index_date"), "yyyy-MM-dd").alias("max_date"),
        F.count("*").alias("subjects"),
    )


def subject_fingerprint(df: DataFrame, subject: str) -> DataFrame:
    """Digest of the distinct ids, independent of their order and the same function at every size.

    Ids are bucketed by the first four hex digits of their own sha256. A bucket's digest is the sha256
    of its newline-joined sorted ids, the result that of the newline-joined sorted bucket digests: at
    most 65,536 of them meet in the last step, and a bucket holds a 65,536th of the ids.
    """
    ids = df.select(F.col(subject).cast("string").alias("id")).where(F.col("id").isNotNull()).distinct()
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    per_bucket = ids.groupBy(F.left(F.sha2("id", 256), F.lit(4)).alias("bucket")).agg(
        digest("id").alias("sha256"), F.count("*").alias("n")
    )
    return per_bucket.agg(digest("sha256").alias("sha256"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("subjects"))


def split_distribution(df: DataFrame, subject: str, split: str = "split", *levels: str) -> DataFrame:
    """Rows and distinct subjects per split and level value, plus the ``all`` rows.

    Subjects are first reduced to one row per (split, level, subject), then counted, so the distinct
    count never gathers one split in a task.
    """
    frames = []
    for level in levels or (None,):
        value = F.col(level).cast("string") if level else F.lit("")
        per_subject = df.groupBy(
            F.col(split).alias("split"), F.lit(level or "total").alias("level"), value.alias("value"),
            F.col(subject).alias("subject"),
        ).agg(F.count("*").alias("rows"))
        frames.append(per_subject)
    out = None
    for per_subject in frames:
        by_split = per_subject.groupBy("split", "level", "value").agg(
            F.sum("rows").cast("bigint").alias("rows"), F.count("*").alias("subjects")
        )
        overall = (
            per_subject.groupBy("level", "value", "subject")
            .agg(F.sum("rows").alias("rows"))
            .groupBy("level", "value")
            .agg(F.sum("rows").cast("bigint").alias("rows"), F.count("*").alias("subjects"))
            .withColumn("split", F.lit("all"))
        )
        both = by_split.unionByName(overall.select("split", "level", "value", "rows", "subjects"))
        out = both if out is None else out.unionByName(both)
    return out
