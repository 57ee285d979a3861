"""Labels, record selection, pairs, time-to-event and splits on literal visits."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from visitline.functions.dates import day_band
from visitline.functions.states import (
    OUTCOME_SCHEME, StateScheme, build_labels, normalize_state, outcome_label_audit, transition_names,
)
from visitline.operators import pairs as J, selection as W, splits as T, survival as E
from visitline.operators.integrity import assert_pair_integrity

SCHEMA = "subject bigint, visit_date string, state string, x int, row_id bigint"


def visits(spark, data):
    df = spark.createDataFrame([(s, d, l, x, i) for i, (s, d, l, x) in enumerate(data)], SCHEMA)
    return df.withColumn("visit_date", F.try_to_timestamp("visit_date").cast("date"))


ARGS = dict(subject="subject", date="visit_date", label="state", row_id="row_id")


def test_band_ends_are_inclusive_in_whole_days():
    assert day_band(6, 60) == (183, 1826)
    assert day_band(12 / 30.4375, 24 / 30.4375) == (12, 24)


@pytest.mark.parametrize(
    "raw, state",
    [("CN", "CN"), (" NL ", "CN"), ("MCI to NL", "CN"), ("NL to MCI", "MCI"), ("Dementia", "AD"), ("mci", None), ("", None),
     ("NL to Dementia", "AD"), ("AD to MCI", None)],
)
def test_alias_table(spark, raw, state):
    assert spark.range(1).select(normalize_state(F.lit(raw)).alias("s")).first()["s"] == state


def test_outcome_labels(spark):
    raw = ["CN", "NL", "Normal", "LMCI", "EMCI", "Dementia", "possible AD", None]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    audit = {r["raw_label"]: r["normalized_label"] for r in outcome_label_audit(df, "raw", OUTCOME_SCHEME).collect()}
    assert audit == {
        "CN": "CN", "NL": "CN", "Normal": "CN", "LMCI": "MCI", "EMCI": "MCI", "Dementia": "AD", "possible AD": None, None: None,
    }


def test_binary_labels_keep_the_outer_states(spark):
    df = spark.createDataFrame([("CN",), ("MCI",), ("AD",), ("?",)], "DX string")
    assert rows(build_labels(df, "DX", "binary"), "DX", "label") == [("AD", 1), ("CN", 0)]
    with pytest.raises(ValueError):
        build_labels(df, "DX", "ordinal")
    with pytest.raises(ValueError):
        build_labels(df, "nope")


def test_pair_beyond_the_band_is_left_out(spark):
    df = visits(spark, [(1, "2020-01-01", "CN", 10), (1, "2021-01-01", "MCI", 20), (1, "2027-01-01", "AD", 30)])
    got = J.future_pairs(df, ["x"], **ARGS).collect()
    assert [(r["x"], r["target_state"], r["label"], r["source_date"]) for r in got] == [(10, "MCI", 1, "2020-01-01")]
    assert 12.0 < got[0]["forecast_months"] < 12.1


def test_future_pairs_allow_unknown_source_and_transitions_do_not(spark):
    df = visits(spark, [(1, "2020-01-01", "?", 1), (1, "2021-01-01", "AD", 99), (2, "bad", "CN", 1), (2, "2021-01-01", "CN", 1)])
    assert J.future_pairs(df, ["x"], **ARGS).count() == 1
    assert J.transition_pairs(df, ["x"], **ARGS).count() == 0


def test_reversions_are_kept(spark):
    df = visits(spark, [(1, "2020-01-01", "AD", 1), (1, "2021-01-01", "MCI", 2)])
    assert J.transition_pairs(df, ["x"], **ARGS).first()["transition"] == "AD -> MCI"
    assert len(transition_names()) == 9


def test_weights_sum_to_one_per_subject(spark):
    df = visits(spark, [(1, "2020-01-01", "CN", 1), (1, "2021-01-01", "CN", 1), (1, "2022-01-01", "MCI", 1),
                        (2, "2020-01-01", "CN", 1), (2, "2021-01-01", "AD", 1)])
    sums = J.transition_pairs(df, ["x"], **ARGS).groupBy("subject").agg(F.sum("subject_weight").alias("w"))
    assert all(abs(r["w"] - 1) < 1e-12 for r in sums.collect())


def test_same_day_visits_pair_in_row_order_when_the_band_starts_at_zero(spark):
    df = visits(spark, [(1, "2020-01-01", "CN", 1), (1, "2020-01-01", "AD", 2)])
    got = J.future_pairs(df, ["x"], min_months=0, **ARGS).collect()
    assert [(r["x"], r["target_state"]) for r in got] == [(1, "AD")]


def brute_pairs(data, low=183, high=1826):
    """All in-band ordered pairs, by definition."""
    out = []
    for i, (s, d, l, _) in enumerate(data):
        for j, (s2, d2, l2, _) in enumerate(data):
            if s == s2 and l and l2 and (d, i) < (d2, j):
                gap = (dt.date.fromisoformat(d2) - dt.date.fromisoformat(d)).days
                if low <= gap <= high:
                    out.append((s, i, j, l, l2, gap))
    return out


@pytest.fixture(scope="module")
def skewed():
    """One subject owns a third of all visits."""
    rng = random.Random(7)
    day = lambda: (dt.date(2010, 1, 1) + dt.timedelta(days=rng.randrange(3000))).isoformat()
    return [(0 if i % 3 == 0 else 1 + i % 40, day(), rng.choice(["CN", "MCI", "AD", None]), i) for i in range(600)]


def test_pairs_and_counts_with_a_hot_subject(spark, skewed):
    df = visits(spark, skewed)
    want = brute_pairs(skewed)
    pairs = J.transition_pairs(df, ["x"], hot_rows=10, **ARGS)  # forces the salted join
    assert rows(pairs, "subject", "source_row", "future_row") == sorted(((s, i, j) for s, i, j, *_ in want), key=repr)
    n = {}
    for s, *_ in want:
        n[s] = n.get(s, 0) + 1
    assert all(abs(r["subject_weight"] - 1 / n[r["subject"]]) < 1e-12 for r in pairs.collect())
    cells = {}
    for _, _, _, a, b, _ in want:
        cells[a, b] = cells.get((a, b), 0) + 1
    counts = J.pair_counts_per_visit(df, **ARGS)
    got = {(r["source_state"], r["future_state"]): r["count"] for r in J.transition_matrix(counts).collect()}
    assert got == cells
    gaps = {}
    for *_, g in want:
        gaps[g] = gaps.get(g, 0) + 1
    hist = J.gap_histogram(df, hot_rows=10, **ARGS)
    assert {r["days"]: r["pairs"] for r in hist.collect()} == gaps


def test_counts_on_timestamps_use_blocks_of_24_hours(spark):
    data = [(1, "2020-01-01 12:00:00", "CN", 0), (1, "2020-01-03 11:59:59", "MCI", 1), (1, "2020-01-03 12:00:00", "AD", 2)]
    df = spark.createDataFrame([(s, d, l, x, i) for i, (s, d, l, x) in enumerate(data)], SCHEMA).withColumn(
        "visit_date", F.to_timestamp("visit_date"))
    band = dict(min_months=2 / 30.4375, max_months=2 / 30.4375)
    assert rows(J.future_pairs(df, [], **band, **ARGS), "target_state") == [("AD",)]
    matrix = J.transition_matrix(J.pair_counts_per_visit(df, **band, **ARGS))
    assert rows(matrix, "source_state", "future_state", "count") == [("CN", "AD", 1)]


def test_pair_integrity(spark):
    df = visits(spark, [(s, f"20{10 + y}-01-01", "CN", y) for s in range(30) for y in range(2)])
    split = T.random_split(df, "subject")
    pairs = J.future_pairs(J.attach_split(df, split, "subject"), ["x"], carry=["split"], **ARGS)
    assert pairs.count() == 30
    assert_pair_integrity(pairs, ["x"])
    with pytest.raises(AssertionError):
        assert_pair_integrity(pairs, ["label"])
    with pytest.raises(AssertionError):
        assert_pair_integrity(pairs.unionByName(pairs.withColumn("split", F.lit("other"))), ["x"])


def test_baseline_record_prefers_the_code(spark):
    data = [(1, "m06", "2020-01-01", 1), (1, " BL", "2020-06-01", 2), (2, "m12", "2021-01-01", 3), (2, "m06", "2020-06-01", 4)]
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(data)], "RID int, VISCODE string, EXAMDATE string, value int, row_id bigint")
    got = W.baseline_records(df, "RID", "VISCODE", "EXAMDATE", "row_id")
    assert rows(got, "RID", "value") == [(1, 2), (2, 4)]


def test_baseline_only_uses_the_code_globally(spark):
    data = [(1, "bl", "2020-01-01"), (1, "m06", "2019-01-01"), (2, "m06", "2020-01-01"), (2, "bl", "2020-02-01")]
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(data)], "RID int, VISCODE string, EXAMDATE string, row_id bigint")
    assert rows(W.task_rows(df, "baseline_only", "RID", "VISCODE", "EXAMDATE", "row_id"), "RID", "VISCODE") == [(1, "bl"), (2, "bl")]
    uncoded = df.where("VISCODE <> 'bl'")
    assert W.task_rows(uncoded, "baseline_only", "RID", "VISCODE", "EXAMDATE", "row_id").count() == 2
    assert W.task_rows(df, "all_visits", "RID", "VISCODE", "EXAMDATE", "row_id").count() == 4
    with pytest.raises(ValueError):
        W.task_rows(df, "other", "RID", "VISCODE", "EXAMDATE", "row_id")


def test_latest_record_keeps_undated_subjects(spark):
    df = spark.createDataFrame([(1, "2020-01-01", 1, 0), (1, "2021-01-01", 2, 1), (2, "bad", 3, 2)], "RID int, EXAMDATE string, x int, row_id bigint")
    assert rows(W.latest_records(df, "RID", "EXAMDATE", "row_id"), "RID", "x") == [(1, 2), (2, 3)]


def test_schema_alignment(spark):
    from pyspark.sql import types as ty

    df = spark.createDataFrame([(1, 2, 3)], "b int, a int, extra int")
    frozen = ty.StructType([ty.StructField("a", ty.IntegerType()), ty.StructField("missing", ty.DoubleType())])
    out = W.align_to_schema(df, frozen)
    assert out.columns == ["a", "missing"] and tuple(out.first()) == (2, None)


def test_blacklist_by_task(spark):
    df = spark.createDataFrame([], "DX string, DXCHANGE int, DX_bl string, VISCODE string, AGE int")
    for task in ("all_visits", "baseline_only"):
        blocked = W.feature_blacklist(task, df)
        assert W.without_blacklisted(df.columns, blocked) == ["AGE"]
    assert "VISCODE" not in W.feature_blacklist("all_visits", df, exclude_visit_code=False)
    with pytest.raises(ValueError, match="absent"):
        W.require_columns(df, ["AGE", "absent"])


def index_of(spark, data):
    return spark.createDataFrame(data, "subject int, max_followup_months double, first_event_months double")


def test_index_visit_needs_a_later_date(spark):
    df = visits(spark, [(1, "2020-01-01", "MCI", 1), (1, "2021-01-01", "AD", 2), (2, "2020-01-01", "MCI", 3),
                        (3, "2020-01-01", "MCI", 4), (3, "2020-01-01", "AD", 5)])
    got = E.index_visits(df, ["x"], **ARGS).collect()
    assert [r["subject"] for r in got] == [1]
    assert abs(got[0]["first_event_months"] - 366 / 30.4375) < 1e-12 and got[0]["x"] == 1


def test_landmark_labels(spark):
    index = index_of(spark, [(1, 20.0, 20.0), (2, 30.0, 31.0), (3, 40.0, None)])
    assert rows(E.landmark_cohort(index, 24), "subject", "label") == [(1, 1), (2, 0), (3, 0)]
    censored = E.landmark_rows(index_of(spark, [(1, 10.0, None), (2, 30.0, None)]), [24])
    summary = E.landmark_summary(censored, []).first()
    assert (summary["eligible_subjects"], summary["censored_subjects"]) == (1, 1)


def test_person_periods_stop_at_the_event(spark):
    got = E.person_periods(index_of(spark, [(1, 60.0, 20.0)]), [12, 24, 36])
    assert rows(got, "elapsed_months", "event", "subject_weight") == [(12, 0, 0.5), (24, 1, 0.5)]
    unobserved = E.person_periods(index_of(spark, [(1, 11.0, None)]), [12, 24])
    assert unobserved.count() == 0


def test_cumulative_risk_is_monotone(spark):
    hazards = [0.1, 0.2, 0.05, 0.4]
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(hazards)], "subject int, interval_index int, hazard double")
    risk = [r["cumulative_risk"] for r in E.cumulative_risk(df).orderBy("interval_index").collect()]
    assert risk == sorted(risk) and abs(risk[-1] - (1 - 0.9 * 0.8 * 0.95 * 0.6)) < 1e-12
    certain = E.cumulative_risk(df.withColumn("hazard", F.lit(1.0)))
    assert all(r["cumulative_risk"] == 1.0 for r in certain.collect())


def brute_temporal(first):
    order = sorted(first, key=lambda s: (first[s], str(s)))
    n = len(order)
    a, b = int(n * 0.7), int(n * 0.7) + int(n * 0.15)
    return {s: "train" if i < a else "validation" if i < b else "temporal_test" for i, s in enumerate(order)}


@pytest.mark.parametrize("days", [1, 3, 400])
def test_temporal_split_matches_the_definition(spark, days):
    rng = random.Random(days)
    first = {s: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(days)) for s in range(1, 1204)}
    data = [(s, d) for s, d in first.items()] + [(s, d + dt.timedelta(days=9)) for s, d in first.items()]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "RID int, EXAMDATE date")
    got = {r["subject"]: r["split"] for r in T.temporal_split(df, "RID", "EXAMDATE").collect()}
    assert got == brute_temporal(first)


def test_stratified_split_sizes_and_disjointness(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(60)] * 2, "RID int, label int")
    out = T.stratified_split(df, "RID", "label", seed=3)
    sizes = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert all(sizes[k, "test"] == 4 and sizes[k, "val"] == 2 and sizes[k, "train"] == 14 for k in range(3))
    T.assert_disjoint(out)
    again = T.stratified_split(df, "RID", "label", seed=3)
    assert rows(out, "subject", "split") == rows(again, "subject", "split")
    other = T.stratified_split(df, "RID", "label", seed=4)
    assert rows(out, "subject", "split") != rows(other, "subject", "split")


def test_stratified_split_falls_back_on_tiny_strata(spark):
    df = spark.createDataFrame([(i, 0 if i else 1) for i in range(20)], "RID int, label int")
    out = T.stratified_split(df, "RID", "label", seed=1)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"test": 4, "val": 2, "train": 14}


def test_stratified_test_with_plain_validation(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(18)], "RID int, label int")
    out = T.stratified_split(df, "RID", "label", seed=1)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"test": 4, "val": 2, "train": 12}
    assert out.select("subject").distinct().count() == 18


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (2, 1), (2, 1), (2, 0)], "RID int, label int")
    assert rows(T.subject_labels(df, "RID", "label")) == [(1, 0), (2, 1)]


def test_folds_are_balanced_and_grouped(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(s,) for s in range(300) for _ in range(rng.randrange(1, 9))], "RID int")
    folds = T.grouped_folds(df, "RID")
    assert folds.count() == 300
    loads = [r["n"] for r in folds.groupBy("fold").agg(F.sum("rows").alias("n")).collect()]
    assert len(loads) == 5 and max(loads) - min(loads) <= 8


def test_folds_are_those_of_a_step_per_subject(spark):
    rng = random.Random(2)
    for _ in range(200):
        loads, rows_, subjects = [rng.randrange(30) for _ in range(rng.randrange(1, 7))], rng.randrange(1, 9), rng.randrange(40)
        now, want = list(loads), [0] * len(loads)
        for _ in range(subjects):
            fold = now.index(min(now))
            now[fold] += rows_
            want[fold] += 1
        assert T.lightest_folds(loads, rows_, subjects) == want
    # One subject owns half of all rows, many own one row, and some rows have no subject.
    df = spark.createDataFrame([(0,)] * 500 + [(s,) for s in range(1, 480)] + [(None,)] * 21, "RID int")
    got = T.grouped_folds(df, "RID", 3)
    loads = {r["fold"]: r["n"] for r in got.groupBy("fold").agg(F.sum("rows").alias("n")).collect()}
    assert loads == {1: 500, 2: 250, 3: 250} and got.count() == 481
    assert T.grouped_folds(df.limit(0), "RID").count() == 0


def test_pair_statistics_sum_the_weights_of_pairs(spark):
    df = visits(spark, [(s, f"20{10 + k}-01-01", "CN", 0) for s in (1, 2) for k in range(2 + s)])
    pairs = J.transition_pairs(df, [], **ARGS)
    counts = J.pair_counts_per_visit(df, **ARGS)
    names = ["effective_weighted_sample_size", "per_subject_weight_sum_min", "per_subject_weight_sum_max"]
    told = lambda p: [x and round(x, 6) for x in J.pair_statistics(counts, pairs=p).select(*names).first()]
    assert told(pairs) == [2.0, 1.0, 1.0]
    assert told(pairs.withColumn("subject_weight", F.col("subject_weight") * F.col("subject"))) == [3.0, 1.0, 2.0]
    assert told(None) == [None, None, None]


def test_fingerprint_ignores_order_and_repeats(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    df = spark.createDataFrame([(i,) for i in [10, 9, 2, 2]], "RID int")
    buckets = sorted(sha(i) for i in ("10", "9", "2"))  # no two in one bucket
    assert T.subject_fingerprint(df, "RID").first()["sha256"] == sha("\n".join(buckets))
    many = spark.range(3000).withColumnRenamed("id", "RID")
    a, b = (T.subject_fingerprint(x, "RID").first() for x in (many, many.orderBy(F.desc("RID"))))
    assert a == b and a["subjects"] == 3000


def test_temporal_split_orders_instants_within_a_minute(spark):
    rows_ = [(f"SUBJ-{99 - i:06d}", f"2020-01-01 00:00:{2 * i:02d}") for i in range(20)]
    df = spark.createDataFrame(rows_, "RID string, d string").withColumn("d", F.col("d").cast("timestamp"))
    got = {r["subject"]: r["split"] for r in T.temporal_split(df, "RID", "d").collect()}
    in_order = [got[s] for s, _ in rows_]
    assert in_order == ["train"] * 14 + ["validation"] * 3 + ["temporal_test"] * 3
    same = spark.createDataFrame([(f"SUBJ-{i:06d}",) for i in range(40)], "RID string").withColumn("d", F.lit("2020-01-01").cast("date"))
    got = {r["subject"]: r["split"] for r in T.temporal_split(same, "RID", "d").collect()}
    assert [got[f"SUBJ-{i:06d}"] for i in range(40)] == ["train"] * 28 + ["validation"] * 6 + ["temporal_test"] * 6


def test_subjects_without_label_are_a_stratum(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(1000)], "RID int, label int")
    sizes = {(r["label"], r["split"]): r["count"] for r in T.stratified_split(df, "RID", "label", seed=3).groupBy("label", "split").count().collect()}
    assert {k: v for k, v in sizes.items() if k[1] == "test"} == {(None, "test"): 40, (0, "test"): 80, (1, "test"): 80}
    assert {k: v for k, v in sizes.items() if k[1] == "val"} == {(None, "val"): 20, (0, "val"): 40, (1, "val"): 40}


def test_pairs_of_a_band_from_zero(spark):
    df = spark.createDataFrame([(1, "2020-01-01", "CN", 1), (1, "2020-01-01", "MCI", 2), (1, "2020-03-01", "AD", 3)], "RID int, d string, DX string, v int").withColumn("d", F.col("d").cast("date"))
    got = J.transition_pairs(df, [], "RID", "d", "DX", "v", min_months=0).select("source_row", "future_row", F.round("subject_weight", 6).alias("w"))
    assert rows(got) == [(1, 2, 0.333333), (1, 3, 0.333333), (2, 3, 0.333333)]


def test_custom_scheme_round_trip(spark):
    scheme = StateScheme(("low", "high"), {"L": "low", "H": "high"})
    df = spark.createDataFrame([("L",), ("H",), ("low",)], "s string")
    assert rows(df.select(normalize_state(F.col("s"), scheme).alias("n"))) == sorted([("low",), ("high",), (None,)], key=repr)
