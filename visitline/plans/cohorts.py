"""Queries: labels, record selection, pairs, time-to-event and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitline.functions import states as S
from visitline.operators import pairs as J, selection as W, splits as T, survival as E
from visitline.plans.registry import query, rounded
from visitline.plans.standins import (
    FEATURES, PAIRS_SQL, SCHEME, SPEC, VISITS_SQL, PLACES_SQL, bare_visits, hash_sql, table, visits,
)

# --- labels ------------------------------------------------------------------------------------

# Raw spellings assembled from two table columns, so every alias rule meets real rows.
_SPELLING = {
    ("F", "1-URGENT"): "CN", ("F", "2-HIGH"): " NL ", ("F", "3-MEDIUM"): "MCI to NL", ("F", "4-NOT SPECIFIED"): "nl",
    ("F", "5-LOW"): "Dementia to NL", ("O", "1-URGENT"): "MCI", ("O", "2-HIGH"): "NL to MCI", ("O", "3-MEDIUM"): "EMCI",
    ("O", "4-NOT SPECIFIED"): "", ("O", "5-LOW"): "Dementia to MCI", ("P", "1-URGENT"): "AD",
    ("P", "2-HIGH"): "Dementia", ("P", "3-MEDIUM"): "MCI to Dementia", ("P", "4-NOT SPECIFIED"): "possible AD",
    ("P", "5-LOW"): "NL to Dementia",
}
_RAW_SQL = "CASE o_orderstatus || '/' || o_orderpriority " + " ".join(
    f"WHEN '{a}/{b}' THEN '{v}'" for (a, b), v in _SPELLING.items()
) + " END"
_ALIAS_SQL = """CASE WHEN trim(raw_label) IN ('CN','NL','NL to NL','MCI to NL','Dementia to NL') THEN 'CN'
  WHEN trim(raw_label) IN ('MCI','NL to MCI','MCI to MCI','Dementia to MCI') THEN 'MCI'
  WHEN trim(raw_label) IN ('AD','Dementia','NL to Dementia','MCI to Dementia') THEN 'AD' END"""


def _spelled(spark, sf):
    key = F.concat_ws("/", "o_orderstatus", "o_orderpriority")
    raw = S.literal_map({f"{a}/{b}": v for (a, b), v in _SPELLING.items()})
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.try_element_at(raw, key).alias("raw_label"))


@query(
    "state_normalization",
    f"""WITH r AS (SELECT o_orderkey, {_RAW_SQL} AS raw_label FROM orders)
    SELECT raw_label, {_ALIAS_SQL} AS state, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2""",
)
def state_normalization(spark, sf):
    rows = _spelled(spark, sf).withColumn("state", S.normalize_state(F.col("raw_label")))
    return rows.groupBy("raw_label", "state").agg(F.count("*").alias("n"))


@query(
    "outcome_label_audit",
    f"""WITH r AS (SELECT {_RAW_SQL} AS raw_label FROM orders)
    SELECT raw_label, CAST(count(*) AS BIGINT) AS count,
      CASE WHEN trim(raw_label) IN ('CN','NL','Normal') THEN 'CN' WHEN trim(raw_label) IN ('MCI','EMCI','LMCI') THEN 'MCI'
           WHEN trim(raw_label) IN ('AD','Dementia') THEN 'AD' END AS normalized_label
    FROM r GROUP BY 1""",
)
def outcome_label_audit(spark, sf):
    return S.outcome_label_audit(_spelled(spark, sf), "raw_label")


@query(
    "label_encoding_multiclass",
    f"""WITH r AS (SELECT o_orderkey, {_RAW_SQL} AS raw_label FROM orders), s AS (SELECT *, {_ALIAS_SQL} AS state FROM r)
    SELECT state, CAST(CASE state WHEN 'CN' THEN 0 WHEN 'MCI' THEN 1 ELSE 2 END AS INTEGER) AS label,
           CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM s WHERE state IS NOT NULL GROUP BY 1, 2""",
)
def label_encoding_multiclass(spark, sf):
    rows = S.build_labels(_spelled(spark, sf), "raw_label")
    return rows.groupBy("state", "label").agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum")
    )


@query(
    "label_encoding_binary",
    f"""WITH r AS (SELECT o_orderkey, {_RAW_SQL} AS raw_label FROM orders), s AS (SELECT *, {_ALIAS_SQL} AS state FROM r)
    SELECT o_orderkey, state, CAST(CASE state WHEN 'CN' THEN 0 ELSE 1 END AS INTEGER) AS label
    FROM s WHERE state IN ('CN', 'AD')""",
)
def label_encoding_binary(spark, sf):
    return S.build_labels(_spelled(spark, sf), "raw_label", "binary").select("o_orderkey", "state", "label")


# --- record selection --------------------------------------------------------------------------


@query(
    "baseline_record",
    f"""WITH {VISITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY
        CASE WHEN lower(trim(visit_code)) = 'bl' THEN 0 ELSE 1 END, visit_date, row_id) AS rn FROM visits)
    SELECT subject, CAST(visit_date AS VARCHAR) AS visit_date, row_id, visit_code FROM r WHERE rn = 1""",
)
def baseline_record(spark, sf):
    picked = W.baseline_records(visits(spark, sf), "subject", "visit_code", "visit_date", "row_id")
    return picked.select("subject", F.col("visit_date").cast("string"), "row_id", "visit_code")


@query(
    "baseline_only_rows",
    f"""WITH {VISITS_SQL}, c AS (SELECT *, trim(visit_code) AS code2 FROM visits),
    r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY visit_date, row_id) AS rn FROM c
          WHERE lower(code2) = 'bl' OR NOT EXISTS (SELECT 1 FROM c WHERE lower(code2) = 'bl'))
    SELECT subject, row_id FROM r WHERE rn = 1""",
)
def baseline_only_rows(spark, sf):
    rows = visits(spark, sf).withColumn("visit_code", F.trim("visit_code"))
    return W.task_rows(rows, "baseline_only", "subject", "visit_code", "visit_date", "row_id").select("subject", "row_id")


@query(
    "all_visit_rows",
    f"WITH {VISITS_SQL} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT subject) AS BIGINT) AS subjects FROM visits",
)
def all_visit_rows(spark, sf):
    rows = W.task_rows(bare_visits(spark, sf), "all_visits", "subject", "visit_code", "visit_date", "row_id")
    # Two-level count: rows per subject first, so no distinct set is gathered.
    return rows.groupBy("subject").agg(F.count("*").alias("k")).agg(
        F.sum("k").alias("n"), F.count("*").alias("subjects")
    )


# Dates before 1996 play the unparseable ones.
_DATE_TEXT = "CASE WHEN visit_date < DATE '1996-01-01' THEN 'bad' ELSE CAST(visit_date AS VARCHAR) END"


def _text_dates(spark, sf):
    rows = bare_visits(spark, sf)
    bad = F.col("visit_date") < F.lit("1996-01-01").cast("date")
    return rows.withColumn("date_text", F.when(bad, "bad").otherwise(F.col("visit_date").cast("string")))


@query(
    "latest_record",
    f"""WITH {VISITS_SQL}, d AS (SELECT subject, row_id, {_DATE_TEXT} AS date_text FROM visits),
    r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY try_cast(date_text AS DATE) DESC NULLS LAST, row_id DESC) AS rn FROM d)
    SELECT subject, row_id, date_text FROM r WHERE rn = 1""",
)
def latest_record(spark, sf):
    return W.latest_records(_text_dates(spark, sf), "subject", "date_text", "row_id").select("subject", "row_id", "date_text")


@query(
    "record_selection_audit",
    f"""WITH {VISITS_SQL}, d AS (SELECT subject, row_id, {_DATE_TEXT} AS date_text FROM visits),
    r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY try_cast(date_text AS DATE) DESC NULLS LAST, row_id DESC) AS rn FROM d)
    SELECT subject, date_text, row_id, rn = 1 AS selected FROM r""",
)
def record_selection_audit(spark, sf):
    rows = _text_dates(spark, sf)
    picked = W.latest_records(rows, "subject", "date_text", "row_id")
    return W.selection_audit(rows, picked, "subject", "date_text", "row_id").select("subject", "date_text", "row_id", "selected")


@query(
    "first_follow_up",
    f"""WITH {VISITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY visit_date, row_id) AS rn
        FROM visits WHERE visit_date >= DATE '2000-01-01')
    SELECT subject, row_id, CAST(visit_date AS VARCHAR) AS visit_date FROM r WHERE rn = 1""",
)
def first_follow_up(spark, sf):
    later = bare_visits(spark, sf).where(F.col("visit_date") >= F.lit("2000-01-01").cast("date"))
    return W.first_follow_up(later, "subject", "visit_date", "row_id").select(
        "subject", "row_id", F.col("visit_date").cast("string")
    )


@query(
    "any_available_rows",
    f"""WITH {VISITS_SQL} SELECT segment, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE priority IS NOT NULL OR balance IS NOT NULL) AS BIGINT) AS available
    FROM visits GROUP BY 1""",
)
def any_available_rows(spark, sf):
    return visits(spark, sf).groupBy("segment").agg(
        F.count("*").alias("n"), F.count_if(W.any_available(["priority", "balance"])).alias("available")
    )


@query(
    "row_missing_fraction",
    f"""WITH {VISITS_SQL} SELECT row_id, round((CASE WHEN spend IS NULL THEN 1 ELSE 0 END + CASE WHEN balance IS NULL THEN 1 ELSE 0 END
       + CASE WHEN priority IS NULL THEN 1 ELSE 0 END + CASE WHEN segment IS NULL THEN 1 ELSE 0 END) / CAST(4 AS DOUBLE), 6) AS missing
    FROM visits""",
)
def row_missing_fraction(spark, sf):
    return rounded(visits(spark, sf).select("row_id", W.missing_fraction(FEATURES).alias("missing")))


@query(
    "group_masking",
    f"""WITH {VISITS_SQL} SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS balance_left, CAST(0 AS BIGINT) AS priority_left,
       CAST(count(segment) AS BIGINT) AS segment_left FROM visits""",
)
def group_masking(spark, sf):
    masked = W.mask_columns(visits(spark, sf), ["balance", "priority"])
    return masked.agg(
        F.count("*").alias("n"),
        F.count("balance").alias("balance_left"),
        F.count("priority").alias("priority_left"),
        F.count("segment").alias("segment_left"),
    )


@query(
    "frozen_schema_alignment",
    f"""WITH {VISITS_SQL} SELECT segment, balance, CAST(NULL AS DOUBLE) AS absent_score, spend, row_id FROM visits""",
)
def frozen_schema_alignment(spark, sf):
    from pyspark.sql import types as ty

    frozen = ty.StructType(
        [
            ty.StructField("segment", ty.StringType()),
            ty.StructField("balance", ty.DoubleType()),
            ty.StructField("absent_score", ty.DoubleType()),
            ty.StructField("spend", ty.DoubleType()),
        ]
    )
    return W.align_to_schema(visits(spark, sf), frozen, keep=["row_id"])


@query(
    "feature_group_projection",
    f"WITH {VISITS_SQL} SELECT row_id, spend, balance, segment FROM visits",
)
def feature_group_projection(spark, sf):
    groups = {"amounts": ["spend", "balance", "no_such_column"], "profile": ["segment", "spend"], "unused": ["priority"]}
    return W.select_groups(visits(spark, sf), ["row_id"], groups, ["amounts", "profile"])


@query(
    "leakage_column_removal",
    f"WITH {VISITS_SQL} SELECT row_id, spend, balance, priority, segment FROM visits",
)
def leakage_column_removal(spark, sf):
    rows = visits(spark, sf)
    blocked = W.feature_blacklist(
        "all_visits", rows, always={"state": "label"}, all_visits={"visit_code": "timing"}, visit_code="visit_code"
    )
    keep = W.without_blacklisted(["state", "visit_code", *FEATURES], blocked)
    return rows.select("row_id", *keep)


# --- pairs -------------------------------------------------------------------------------------


@query(
    "future_pairs",
    f"""WITH {PAIRS_SQL} SELECT subject, CAST(visit_date AS VARCHAR) AS source_date, CAST(future_date AS VARCHAR) AS future_date,
       row_id AS source_row, future_row, round(months, 6) AS forecast_months, future_state AS target_state,
       CAST(future_code AS INTEGER) AS label, spend, segment FROM pairs""",
)
def future_pairs(spark, sf):
    return rounded(J.future_pairs(visits(spark, sf), ["spend", "segment"], **SPEC).drop("source_state"))


@query(
    "transition_pairs",
    f"""WITH {PAIRS_SQL} SELECT subject, row_id AS source_row, future_row, round(months, 6) AS forecast_months,
       state AS source_state, future_state, CAST(future_code AS INTEGER) AS label, spend,
       state || ' -> ' || future_state AS transition, round(1.0 / count(*) OVER (PARTITION BY subject), 6) AS subject_weight
    FROM pairs""",
)
def transition_pairs(spark, sf):
    return rounded(J.transition_pairs(bare_visits(spark, sf), ["spend"], **SPEC).drop("source_date", "future_date"))


@query(
    "transition_matrix",
    f"""WITH {PAIRS_SQL} SELECT state AS source_state, future_state, CAST(count(*) AS BIGINT) AS count FROM pairs GROUP BY 1, 2""",
)
def transition_matrix(spark, sf):
    return J.transition_matrix(J.pair_counts_per_visit(bare_visits(spark, sf), **SPEC), SCHEME)


_DAY_PAIRS = """ev AS (SELECT user_id AS subject, ts, event_type AS state, event_id FROM events WHERE event_type IN ('click','view','purchase')),
day_pairs AS (SELECT a.state AS source_state, b.state AS future_state
  FROM ev a JOIN ev b ON a.subject = b.subject AND b.ts > a.ts
   AND floor((epoch_us(b.ts) - epoch_us(a.ts)) / CAST(86400000000 AS DOUBLE)) BETWEEN 2 AND 9)"""


@query(
    "timed_transition_matrix",
    f"WITH {_DAY_PAIRS} SELECT source_state, future_state, CAST(count(*) AS BIGINT) AS count FROM day_pairs GROUP BY 1, 2",
)
def timed_transition_matrix(spark, sf):
    """Instants with a time part: a day is a completed block of 24 hours."""
    scheme = S.StateScheme(("view", "click", "purchase"))
    counts = J.pair_counts_per_visit(
        table(spark, sf, "events"), "user_id", "ts", "event_type", "event_id", 2 / 30.4375, 9 / 30.4375, scheme
    )
    return J.transition_matrix(counts, scheme)


@query(
    "transition_matrix_by_split",
    f"""WITH {PAIRS_SQL}, s AS (SELECT subject, CASE WHEN min(visit_date) < DATE '1996-01-01' THEN 'train' ELSE 'temporal_test' END AS split
        FROM visits GROUP BY 1)
    SELECT split, state AS source_state, future_state, CAST(count(*) AS BIGINT) AS count FROM pairs JOIN s USING (subject) GROUP BY 1, 2, 3""",
)
def transition_matrix_by_split(spark, sf):
    rows = bare_visits(spark, sf)
    tagged = J.attach_split(rows, _early_late(rows), "subject")
    counts = J.pair_counts_per_visit(tagged, carry=["split"], **SPEC)
    return J.transition_matrix(counts, SCHEME, ["split"])


def _early_late(rows):
    first = rows.groupBy("subject").agg(F.min("visit_date").alias("first"))
    early = F.col("first") < F.lit("1996-01-01").cast("date")
    return first.select("subject", F.when(early, "train").otherwise("temporal_test").alias("split"))


@query(
    "split_lookup",
    f"""WITH {VISITS_SQL}, s AS (SELECT CAST(subject AS VARCHAR) AS k, CASE WHEN min(visit_date) < DATE '1996-01-01' THEN 'train' ELSE 'validation' END AS split
        FROM visits WHERE segment <> 'BUILDING' GROUP BY 1)
    SELECT coalesce(split, 'excluded') AS split, CAST(count(*) AS BIGINT) AS n FROM visits LEFT JOIN s ON CAST(subject AS VARCHAR) = k GROUP BY 1""",
)
def split_lookup(spark, sf):
    rows = visits(spark, sf)
    first = rows.where(F.col("segment") != "BUILDING").groupBy("subject").agg(F.min("visit_date").alias("first"))
    early = F.col("first") < F.lit("1996-01-01").cast("date")
    assignment = first.select(F.col("subject").cast("string"), F.when(early, "train").otherwise("validation").alias("split"))
    tagged = J.attach_split(rows, assignment, "subject", drop_excluded=False)
    return tagged.groupBy("split").agg(F.count("*").alias("n"))


@query(
    "pairs_by_split",
    f"""WITH {PAIRS_SQL}, s AS (SELECT subject, CASE WHEN min(visit_date) < DATE '1996-01-01' THEN 'train' ELSE 'temporal_test' END AS split
        FROM visits GROUP BY 1)
    SELECT split, subject, row_id AS source_row, future_row, CAST(future_code AS INTEGER) AS label FROM pairs JOIN s USING (subject)""",
)
def pairs_by_split(spark, sf):
    rows = bare_visits(spark, sf)
    tagged = J.attach_split(rows, _early_late(rows), "subject")
    return J.future_pairs(tagged, [], carry=["split"], **SPEC).select("split", "subject", "source_row", "future_row", "label")


@query(
    "pair_statistics",
    f"""WITH {PAIRS_SQL}, w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY subject) AS weight FROM pairs),
    c AS (SELECT subject, count(*) AS k, sum(weight) AS ws FROM w GROUP BY 1)
    SELECT CAST((SELECT count(*) FROM c) AS BIGINT) AS subjects, CAST((SELECT count(*) FROM pairs) AS BIGINT) AS total_pairs,
      (SELECT CAST(quantile_cont(k, 0.5) AS DOUBLE) FROM c) AS median_pairs_per_subject,
      CAST((SELECT max(k) FROM c) AS BIGINT) AS maximum_pairs_per_subject,
      round((SELECT sum(weight) FROM w), 6) AS effective_weighted_sample_size,
      round((SELECT min(ws) FROM c), 6) AS per_subject_weight_sum_min, round((SELECT max(ws) FROM c), 6) AS per_subject_weight_sum_max,
      CAST((SELECT count(*) FROM pairs WHERE future_state = 'F') AS BIGINT) AS "future_F",
      CAST((SELECT count(*) FROM pairs WHERE future_state = 'O') AS BIGINT) AS "future_O",
      CAST((SELECT count(*) FROM pairs WHERE future_state = 'P') AS BIGINT) AS "future_P" """,
)
def pair_statistics(spark, sf):
    base = bare_visits(spark, sf)
    return rounded(J.pair_statistics(J.pair_counts_per_visit(base, **SPEC), SCHEME, J.transition_pairs(base, [], **SPEC)))


@query(
    "forecast_month_description",
    f"""WITH {PAIRS_SQL} SELECT CAST(count(*) AS BIGINT) AS count, round(avg(months), 6) AS mean, round(stddev_samp(months), 6) AS std,
       round(min(months), 6) AS min, round(quantile_cont(months, 0.25), 6) AS p25, round(quantile_cont(months, 0.5), 6) AS p50,
       round(quantile_cont(months, 0.75), 6) AS p75, round(max(months), 6) AS max FROM pairs""",
)
def forecast_month_description(spark, sf):
    gaps = J.gap_histogram(bare_visits(spark, sf), **SPEC)
    return rounded(J.weighted_describe(gaps, F.col("days") / F.lit(30.4375), F.col("pairs")))


@query(
    "pair_summary_by_split",
    f"""WITH {PAIRS_SQL}, s AS (SELECT subject, CASE WHEN min(visit_date) < DATE '1996-01-01' THEN 'train' ELSE 'temporal_test' END AS split
        FROM visits GROUP BY 1)
    SELECT split, CAST(count(DISTINCT subject) AS BIGINT) AS subjects, CAST(count(*) AS BIGINT) AS pairs,
       round(count(*) / CAST(count(DISTINCT subject) AS DOUBLE), 6) AS pairs_per_subject_mean,
       CAST(count(*) FILTER (WHERE future_state = 'F') AS BIGINT) AS "target_F", CAST(count(*) FILTER (WHERE future_state = 'O') AS BIGINT) AS "target_O",
       CAST(count(*) FILTER (WHERE future_state = 'P') AS BIGINT) AS "target_P"
    FROM pairs JOIN s USING (subject) GROUP BY 1""",
)
def pair_summary_by_split(spark, sf):
    rows = bare_visits(spark, sf)
    tagged = J.attach_split(rows, _early_late(rows), "subject")
    return rounded(J.pair_summary_by_split(J.pair_counts_per_visit(tagged, carry=["split"], **SPEC), SCHEME))


# --- time to event -----------------------------------------------------------------------------

INDEX_SQL = f"""{VISITS_SQL},
first_at_risk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY visit_date, row_id) AS rn
                  FROM visits WHERE state = 'O') WHERE rn = 1),
idx AS (SELECT f.subject, f.visit_date, f.spend, f.balance, f.priority, f.segment,
   max(date_diff('day', f.visit_date, v.visit_date)) / 30.4375 AS max_followup_months,
   min(CASE WHEN v.state = 'P' THEN date_diff('day', f.visit_date, v.visit_date) END) / 30.4375 AS first_event_months
  FROM first_at_risk f JOIN visits v ON v.subject = f.subject AND v.visit_date > f.visit_date GROUP BY ALL)"""
HORIZONS = [12, 24, 36, 48]
INTERVALS = [12, 24, 36, 48, 60]


def index_frame(spark, sf):
    return E.index_visits(visits(spark, sf), FEATURES, at_risk="O", event="P", **SPEC)


@query(
    "index_visits",
    f"""WITH {INDEX_SQL} SELECT subject, CAST(visit_date AS VARCHAR) AS source_date, round(max_followup_months, 6) AS max_followup_months,
       round(first_event_months, 6) AS first_event_months, spend, balance, priority, segment FROM idx""",
)
def index_visits(spark, sf):
    return rounded(index_frame(spark, sf))


_LANDMARK_SQL = f"""{INDEX_SQL}, lm AS (SELECT idx.*, CAST(h AS DOUBLE) AS horizon_months,
  CASE WHEN first_event_months <= h + 6 THEN 1 WHEN max_followup_months >= h - 6 THEN 0 END AS label
  FROM idx, (VALUES (12), (24), (36), (48)) t(h))"""


@query(
    "landmark_cohort",
    f"""WITH {_LANDMARK_SQL} SELECT subject, horizon_months, horizon_months - 6 AS lower_months, horizon_months + 6 AS upper_months,
       CAST(label AS INTEGER) AS label FROM lm WHERE label IS NOT NULL""",
)
def landmark_cohort(spark, sf):
    rows = E.landmark_rows(index_frame(spark, sf), HORIZONS).where(F.col("label").isNotNull())
    return rows.select("subject", "horizon_months", "lower_months", "upper_months", "label")


@query(
    "landmark_summary",
    f"""WITH {_LANDMARK_SQL} SELECT horizon_months, CAST(count(label) AS BIGINT) AS eligible_subjects,
      CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS converters, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS non_converters,
      CAST(count(*) - count(label) AS BIGINT) AS censored_subjects, round(avg(CAST(label AS DOUBLE)), 6) AS class_prevalence,
      round(avg(spend) FILTER (WHERE label IS NOT NULL), 6) AS spend_mean, round(avg(balance) FILTER (WHERE label IS NOT NULL), 6) AS balance_mean,
      round(avg(CASE WHEN lower(segment) = 'building' THEN 1.0 ELSE 0.0 END) FILTER (WHERE label IS NOT NULL), 6) AS segment_fraction,
      round(avg(((CASE WHEN spend IS NULL THEN 1 ELSE 0 END) + (CASE WHEN balance IS NULL THEN 1 ELSE 0 END)
           + (CASE WHEN priority IS NULL THEN 1 ELSE 0 END) + (CASE WHEN segment IS NULL THEN 1 ELSE 0 END)) / CAST(4 AS DOUBLE)) FILTER (WHERE label IS NOT NULL), 6) AS feature_missing_rate
    FROM lm GROUP BY 1""",
)
def landmark_summary(spark, sf):
    rows = E.landmark_rows(index_frame(spark, sf), HORIZONS)
    return rounded(E.landmark_summary(rows, FEATURES, ["spend", "balance"], ("segment", "Building")))


_PERIOD_SQL = f"""{INDEX_SQL}, iv AS (SELECT * FROM (VALUES (1, 0, 12), (2, 12, 24), (3, 24, 36), (4, 36, 48), (5, 48, 60)) t(i, s, e)),
pp AS (SELECT idx.subject, i, s, e, CASE WHEN first_event_months > s AND first_event_months <= e THEN 1 ELSE 0 END AS event
  FROM idx, iv WHERE (first_event_months IS NULL OR first_event_months > s)
   AND ((first_event_months > s AND first_event_months <= e) OR max_followup_months >= e))"""


@query(
    "person_periods",
    f"""WITH {_PERIOD_SQL} SELECT subject, CAST(i AS INTEGER) AS interval_index, CAST(s AS DOUBLE) AS interval_start_months,
      CAST(e AS INTEGER) AS elapsed_months, CAST(event AS INTEGER) AS event, round(1.0 / count(*) OVER (PARTITION BY subject), 6) AS subject_weight FROM pp""",
)
def person_periods(spark, sf):
    rows = E.person_periods(index_frame(spark, sf), INTERVALS)
    return rounded(rows.select("subject", "interval_index", "interval_start_months", "elapsed_months", "event", "subject_weight"))


# A hazard both engines can derive: the share of the subject number within 50 steps, over 100.
_RISK_SQL = f"""{INDEX_SQL}, h AS (SELECT subject, i, e, ((subject * 31 + i * 7) % 50) / CAST(100 AS DOUBLE) AS hazard
  FROM idx, (VALUES (1, 12), (2, 24), (3, 36), (4, 48), (5, 60)) t(i, e)),
risk AS (SELECT a.subject, a.i, a.e, a.hazard, 1 - product(1 - b.hazard) AS cumulative_risk
  FROM h a JOIN h b ON a.subject = b.subject AND b.i <= a.i GROUP BY ALL)"""


def _risk(spark, sf):
    grid = E.risk_grid(index_frame(spark, sf).select("subject"), INTERVALS)
    hazard = ((F.col("subject") * 31 + F.col("interval_index") * 7) % 50) / F.lit(100.0)
    return E.cumulative_risk(grid.withColumn("hazard", hazard))


@query(
    "cumulative_risk",
    f"""WITH {_RISK_SQL} SELECT subject, CAST(e AS INTEGER) AS elapsed_months, round(hazard, 6) AS hazard, round(cumulative_risk, 6) AS cumulative_risk FROM risk""",
)
def cumulative_risk(spark, sf):
    return rounded(_risk(spark, sf).drop("interval_index"))


@query(
    "risk_curve",
    f"""WITH {_RISK_SQL} SELECT CAST(e AS INTEGER) AS elapsed_months, round(avg(cumulative_risk), 6) AS mean_risk,
       round(quantile_cont(cumulative_risk, 0.5), 6) AS median_risk FROM risk GROUP BY 1""",
)
def risk_curve(spark, sf):
    return rounded(E.risk_curve(_risk(spark, sf)))


# --- splits ------------------------------------------------------------------------------------

SPLIT_SQL = f"""{VISITS_SQL}, fd AS (SELECT subject, min(visit_date) AS index_date FROM visits GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY index_date, CAST(subject AS VARCHAR)) AS r, count(*) OVER () AS n FROM fd),
split AS (SELECT subject, index_date, CASE WHEN r <= floor(n * 0.70) THEN 'train'
   WHEN r <= floor(n * 0.70) + floor(n * 0.15) THEN 'validation' ELSE 'temporal_test' END AS split FROM rk)"""


@query(
    "temporal_split",
    f"WITH {SPLIT_SQL} SELECT subject, CAST(index_date AS VARCHAR) AS index_date, split FROM split",
)
def temporal_split(spark, sf):
    out = T.temporal_split(bare_visits(spark, sf), "subject", "visit_date")
    return out.withColumn("index_date", F.col("index_date").cast("string"))


@query(
    "split_cut_dates",
    f"""WITH {SPLIT_SQL} SELECT split, CAST(min(index_date) AS VARCHAR) AS min_date, CAST(max(index_date) AS VARCHAR) AS max_date,
        CAST(count(*) AS BIGINT) AS subjects FROM split GROUP BY 1""",
)
def split_cut_dates(spark, sf):
    return T.cut_dates(T.temporal_split(bare_visits(spark, sf), "subject", "visit_date"))


@query(
    "subject_fingerprint",
    """SELECT sha256(string_agg(d, chr(10) ORDER BY d)) AS sha256, CAST(sum(n) AS BIGINT) AS subjects
    FROM (SELECT sha256(string_agg(id, chr(10) ORDER BY id)) AS d, count(*) AS n
      FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders) GROUP BY left(sha256(id), 4))""",
)
def subject_fingerprint(spark, sf):
    return T.subject_fingerprint(bare_visits(spark, sf), "subject")


@query(
    "split_overlap",
    f"""WITH {VISITS_SQL}, a AS (SELECT subject, CASE WHEN state = 'F' THEN 'train' ELSE 'test' END AS split FROM visits)
    SELECT subject, CAST(count(DISTINCT split) AS BIGINT) AS n_splits FROM a GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def split_overlap(spark, sf):
    rows = bare_visits(spark, sf)
    return T.overlapping_subjects(
        rows.withColumn("split", F.when(F.col("state") == "F", "train").otherwise("test")), "subject"
    )


@query(
    "split_distribution",
    f"""WITH {SPLIT_SQL}, j AS (SELECT v.*, s.split FROM visits v JOIN split s USING (subject)),
    g AS (SELECT split, state, subject FROM j UNION ALL SELECT 'all', state, subject FROM j)
    SELECT split, 'state' AS level, state AS value, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT subject) AS BIGINT) AS subjects FROM g GROUP BY 1, 3
    UNION ALL SELECT split, 'total', '', CAST(count(*) AS BIGINT), CAST(count(DISTINCT subject) AS BIGINT) FROM g GROUP BY 1""",
)
def split_distribution(spark, sf):
    rows = bare_visits(spark, sf)
    tagged = J.attach_split(rows, T.temporal_split(rows, "subject", "visit_date"), "subject")
    return T.split_distribution(tagged, "subject", "split", "state").unionByName(T.split_distribution(tagged, "subject"))


@query(
    "subject_label_mode",
    """WITH c AS (SELECT o_custkey AS subject, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT subject, label FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, label) AS r FROM c) WHERE r = 1""",
)
def subject_label_mode(spark, sf):
    return T.subject_labels(bare_visits(spark, sf), "subject", "state")


_STRATA_SQL = """WITH c AS (SELECT o_custkey AS subject, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1, 2),
 s AS (SELECT label, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, label) AS r FROM c) WHERE r = 1 GROUP BY 1),
 t AS (SELECT *, sum(n) OVER () AS total, CAST(ceil(sum(n) OVER () * 0.2) AS BIGINT) AS take FROM s),
 f AS (SELECT *, CAST(floor(take * n / CAST(total AS DOUBLE)) AS BIGINT) AS base, take * n / CAST(total AS DOUBLE) AS ex FROM t),
 a AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY ex - base DESC, label) <= take - sum(base) OVER () THEN 1 ELSE 0 END AS n_test FROM f),
 v AS (SELECT *, n - n_test AS rest, CAST(ceil((total - take) * (0.1 / (1.0 - 0.2))) AS BIGINT) AS vtake FROM a),
 w AS (SELECT *, sum(rest) OVER () AS rtotal FROM v),
 x AS (SELECT *, vtake * rest / CAST(rtotal AS DOUBLE) AS vex FROM w),
 y AS (SELECT *, CAST(floor(vex) AS BIGINT) AS vbase FROM x),
 z AS (SELECT *, vbase + CASE WHEN row_number() OVER (ORDER BY vex - vbase DESC, label) <= vtake - sum(vbase) OVER () THEN 1 ELSE 0 END AS n_val FROM y)"""
_STRATA_SIZES_SQL = f"""{_STRATA_SQL}
 SELECT label, 'test' AS split, CAST(n_test AS BIGINT) AS subjects FROM z UNION ALL SELECT label, 'val', CAST(n_val AS BIGINT) FROM z
 UNION ALL SELECT label, 'train', CAST(rest - n_val AS BIGINT) FROM z"""


@query("stratified_split_sizes", _STRATA_SIZES_SQL)
def stratified_split_sizes(spark, sf):
    out = T.stratified_split(bare_visits(spark, sf), "subject", "state", seed=42)
    return out.groupBy("label", "split").agg(F.count("*").alias("subjects"))


@query(
    "random_split_sizes",
    """WITH n AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), t AS (SELECT n, CAST(ceil(n * 0.2) AS BIGINT) AS te FROM n),
    v AS (SELECT n, te, CAST(ceil((n - te) * (0.1 / (1.0 - 0.2))) AS BIGINT) AS va FROM t)
    SELECT 'test' AS split, te AS subjects FROM v UNION ALL SELECT 'val', va FROM v UNION ALL SELECT 'train', n - te - va FROM v""",
)
def random_split_sizes(spark, sf):
    return T.random_split(bare_visits(spark, sf), "subject").groupBy("split").agg(F.count("*").alias("subjects"))


@query(
    "stratified_split",
    f"""{_STRATA_SQL}, l AS (SELECT subject, label FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, label) AS r FROM c) WHERE r = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('subject')}, subject) - 1 AS position FROM l)
    SELECT subject, label, CASE WHEN position < n_test THEN 'test' WHEN position < n_test + n_val THEN 'val' ELSE 'train' END AS split
    FROM p JOIN z USING (label)""",
)
def stratified_split(spark, sf):
    return T.stratified_split(bare_visits(spark, sf), "subject", "state", seed=42)


@query(
    "random_split",
    f"""WITH {PLACES_SQL}, t AS (SELECT *, ceil(n * 0.2) AS te FROM places), v AS (SELECT *, ceil((n - te) * (0.1 / (1.0 - 0.2))) AS va FROM t)
    SELECT subject, CASE WHEN position < te THEN 'test' WHEN position < te + va THEN 'val' ELSE 'train' END AS split FROM v""",
)
def random_split(spark, sf):
    return T.random_split(bare_visits(spark, sf), "subject", seed=42)


@query(
    "grouped_folds",
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT o_custkey AS subject, count(*) AS rows FROM orders GROUP BY 1),
    o AS MATERIALIZED (SELECT rows, row_number() OVER (ORDER BY rows DESC) AS i FROM s),
    g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS rows, 0 AS fold, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads
      UNION ALL SELECT i, rows, fold, [loads[j] + CASE WHEN j = fold THEN rows ELSE 0 END FOR j IN range(1, 6)]
      FROM (SELECT o.i, o.rows, list_position(g.loads, list_min(g.loads)) AS fold, g.loads FROM g JOIN o ON o.i = g.i + 1)),
    p AS (SELECT *, row_number() OVER (PARTITION BY rows ORDER BY {hash_sql('subject')}, subject) AS position FROM s),
    d AS (SELECT rows, fold, row_number() OVER (PARTITION BY rows ORDER BY fold, i) AS position FROM g WHERE i > 0)
    SELECT subject, rows, CAST(fold AS INTEGER) AS fold FROM p JOIN d USING (rows, position)""",
)
def grouped_folds(spark, sf):
    return T.grouped_folds(bare_visits(spark, sf), "subject")
