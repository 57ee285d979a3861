"""Queries: schema compatibility, drift, outcome matching and integrity gates.

Training = orders before 1999, scoring = last order of each customer before 2000, outcomes = later
orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from visitline.functions import probability as P
from visitline.functions.states import StateScheme
from visitline.operators import drift as D, integrity as I, pairs as J, selection as W, splits as T
from visitline.plans.registry import query, rounded
from visitline.plans.standins import (
    PAIRS_SQL, PRED_SQL, SCHEME, SPEC, VISITS_SQL, bare_visits, predictions, visits,
)


def _day(text: str):
    return F.lit(text).cast("date")


def _train(spark, sf):
    return visits(spark, sf).where(F.col("visit_date") < _day("1999-01-01"))


def _scoring(spark, sf):
    before = visits(spark, sf).where(F.col("visit_date") < _day("2000-01-01"))
    return W.latest_records(before, "subject", "visit_date", "row_id")


_SIDES_SQL = f"""{VISITS_SQL}, train AS (SELECT * FROM visits WHERE visit_date < DATE '1999-01-01'),
 scoring AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY visit_date DESC, row_id DESC) AS rn
   FROM visits WHERE visit_date < DATE '2000-01-01') WHERE rn = 1)"""

# Scoring lacks `visit_code`, has a numeric `segment` and priorities training never had.
_SCORE_SQL = f"""{_SIDES_SQL}, sc AS (SELECT spend, balance, CASE WHEN spend > 300000 THEN priority || '*' ELSE priority END AS priority FROM scoring)"""


def _scoring_variant(spark, sf):
    starred = F.when(F.col("spend") > 300000, F.concat("priority", F.lit("*"))).otherwise(F.col("priority"))
    return _scoring(spark, sf).select("spend", "balance", starred.alias("priority"), F.col("row_id").alias("segment"))


def _compat_row(c: str, kind: str) -> str:
    if kind == "both":
        unseen = (
            "(SELECT count(*) FROM (SELECT DISTINCT priority AS v FROM sc WHERE priority IS NOT NULL AND priority NOT IN (SELECT DISTINCT priority FROM train WHERE priority IS NOT NULL)))"
            if c == "priority" else "CAST(0 AS BIGINT)"
        )
        return (
            f"SELECT '{c}' AS feature, true AS train_present, true AS scoring_present, round(1 - a.n / a.t, 6) AS train_missing_rate, round(1 - b.n / b.t, 6) AS scoring_missing_rate,"
            f" round((1 - b.n / b.t) - (1 - a.n / a.t), 6) + 0.0 AS missing_rate_shift, true AS dtype_compatible, {unseen} AS unseen_levels"
            f" FROM (SELECT CAST(count({c}) AS DOUBLE) AS n, count(*) AS t FROM train) a, (SELECT CAST(count({c}) AS DOUBLE) AS n, count(*) AS t FROM sc) b"
        )
    return kind


_COMPAT_SQL = " UNION ALL ".join(
    [
        _compat_row("spend", "both"), _compat_row("balance", "both"), _compat_row("priority", "both"),
        "SELECT 'visit_code', true, false, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), false, CAST(0 AS BIGINT)",
        "SELECT 'segment', true, true, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), false, (SELECT count(*) FROM scoring)",
        "SELECT 'no_such', false, false, CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), false, CAST(0 AS BIGINT)",
    ]
)
_FROZEN = ["spend", "balance", "priority", "visit_code", "segment", "no_such"]


@query("schema_compatibility", f"WITH {_SCORE_SQL} {_COMPAT_SQL}")
def schema_compatibility(spark, sf):
    return rounded(D.schema_compatibility(_train(spark, sf), _scoring_variant(spark, sf), _FROZEN))


@query(
    "unseen_levels",
    f"""WITH {_SCORE_SQL} SELECT 'priority' AS feature, v FROM
    (SELECT DISTINCT priority AS v FROM sc WHERE priority IS NOT NULL EXCEPT SELECT DISTINCT priority FROM train)""",
)
def unseen_levels(spark, sf):
    return D.unseen_level_rows(_train(spark, sf), _scoring_variant(spark, sf), ["priority"])


@query(
    "deployment_decision",
    f"""WITH {VISITS_SQL} SELECT 'compact' AS primary_candidate, 'full' AS sensitivity_candidate, false AS full_compatible, round(5 / CAST(6 AS DOUBLE) - 1 / CAST(6 AS DOUBLE), 6) AS full_feature_presence_ratio,
      CAST(0.95 AS DOUBLE) AS feature_threshold, false AS required_groups_available, count(*) > 0 AS severe_dtype_mismatch FROM visits""",
)
def deployment_decision(spark, sf):
    table = D.schema_compatibility(_train(spark, sf), _scoring_variant(spark, sf), _FROZEN)
    groups = {"spend": "money", "balance": "money", "priority": "profile", "segment": "profile", "visit_code": "timing"}
    return rounded(D.deployment_decision(table, groups, ["money", "profile", "timing"]))


_PSI_EDGES = ", ".join(f"quantile_cont(v, {i / 10}) AS e{i}" for i in range(1, 10))
_BIN = " + ".join(f"(v > e{i})::INT" for i in range(1, 10))
_SHIFT_SQL = f"""{_SIDES_SQL}, rows AS (SELECT 'spend' AS feature, spend AS v, 0 AS s FROM train UNION ALL SELECT 'balance', balance, 0 FROM train WHERE balance IS NOT NULL
   UNION ALL SELECT 'spend', spend, 1 FROM scoring UNION ALL SELECT 'balance', balance, 1 FROM scoring WHERE balance IS NOT NULL),
 mom AS (SELECT feature, avg(v) FILTER (WHERE s = 0) AS m0, stddev_samp(v) FILTER (WHERE s = 0) AS s0, avg(v) FILTER (WHERE s = 1) AS m1, stddev_samp(v) FILTER (WHERE s = 1) AS s1 FROM rows GROUP BY 1),
 tot AS (SELECT feature, CAST(count(*) FILTER (WHERE s = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (WHERE s = 1) AS DOUBLE) AS n1 FROM rows GROUP BY 1),
 ecdf AS (SELECT feature, v, sum(count(*) FILTER (WHERE s = 0)) OVER w AS c0, sum(count(*) FILTER (WHERE s = 1)) OVER w AS c1 FROM rows GROUP BY feature, v WINDOW w AS (PARTITION BY feature ORDER BY v)),
 ks AS (SELECT feature, max(abs(c0 / n0 - c1 / n1)) AS ks FROM ecdf JOIN tot USING (feature) GROUP BY 1),
 edges AS (SELECT feature, {_PSI_EDGES} FROM rows WHERE s = 0 GROUP BY 1),
 bins AS (SELECT feature, {_BIN} AS b, count(*) FILTER (WHERE s = 0) AS a, count(*) FILTER (WHERE s = 1) AS c FROM rows JOIN edges USING (feature) GROUP BY 1, 2),
 sh AS (SELECT feature, greatest(a / n0, 1e-6) AS p, greatest(c / n1, 1e-6) AS q FROM bins JOIN tot USING (feature)),
 psi AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM sh GROUP BY 1)"""


@query(
    "distribution_shift",
    f"""WITH {_SHIFT_SQL} SELECT feature, round(m0, 6) AS train_mean, round(s0, 6) AS train_std, round(m1, 6) AS scoring_mean, round(s1, 6) AS scoring_std,
      round((m1 - m0) / sqrt((s0 * s0 + s1 * s1) / 2), 6) AS standardized_mean_difference, round(ks, 6) AS ks_statistic, round(psi, 6) AS psi
    FROM mom JOIN ks USING (feature) JOIN psi USING (feature)""",
)
def distribution_shift(spark, sf):
    return rounded(D.numeric_shift(_train(spark, sf), _scoring(spark, sf), ["spend", "balance"]))


@query(
    "confidence_shift",
    f"""WITH {PRED_SQL} SELECT split AS cohort, round(avg(conf), 6) AS confidence_mean, round(stddev_samp(conf), 6) AS confidence_std,
      round(avg(-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2))), 6) AS entropy_mean, round(stddev_samp(-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2))), 6) AS entropy_std FROM pred GROUP BY 1""",
)
def confidence_shift(spark, sf):
    return rounded(D.confidence_shift(predictions(spark, sf), F.col("prob"), "split"))


@query(
    "scoring_cohort_summary",
    f"""WITH {_SIDES_SQL}, src AS (SELECT * FROM visits WHERE visit_date < DATE '2000-01-01'),
    c AS (SELECT subject, count(*) AS n FROM src GROUP BY 1)
    SELECT CAST((SELECT count(*) FROM src) AS BIGINT) AS source_rows, CAST((SELECT count(*) FROM c) AS BIGINT) AS unique_subjects,
      CAST((SELECT count(*) FROM c WHERE n > 1) AS BIGINT) AS duplicate_subjects, CAST(count(*) AS BIGINT) AS selected_rows,
      round(count(visit_date) / CAST(count(*) AS DOUBLE), 6) AS index_date_coverage,
      round(avg(((spend IS NOT NULL)::INT + (balance IS NOT NULL)::INT + (priority IS NOT NULL)::INT + (segment IS NOT NULL)::INT) / CAST(4 AS DOUBLE)), 6) AS cell_coverage,
      round(avg((spend IS NOT NULL OR balance IS NOT NULL)::INT), 6) AS coverage_money, round(avg((priority IS NOT NULL)::INT), 6) AS coverage_profile FROM scoring""",
)
def scoring_cohort_summary(spark, sf):
    source = visits(spark, sf).where(F.col("visit_date") < _day("2000-01-01"))
    return rounded(
        D.scoring_cohort_summary(
            source, _scoring(spark, sf), "subject", "visit_date", ["spend", "balance", "priority", "segment"],
            {"money": ["spend", "balance"], "profile": ["priority"]},
        )
    )


# --- matching ----------------------------------------------------------------------------------

_OUT_SCHEME = StateScheme(("F", "O", "P"), {"F": "F", "O": "O"})
_MATCH_SQL = f"""{_SIDES_SQL}, outc AS (SELECT subject, row_id AS outcome_row, visit_date AS outcome_date, state AS raw_label FROM visits WHERE visit_date >= DATE '2000-01-01'),
 mt AS (SELECT o.*, s.row_id AS index_row, s.visit_date AS index_date, CASE WHEN raw_label IN ('F', 'O') THEN raw_label END AS outcome_state,
   date_diff('day', s.visit_date, o.outcome_date) / 30.4375 AS forecast_months, s.subject IS NOT NULL AS found FROM outc o LEFT JOIN (SELECT * FROM scoring WHERE segment <> 'BUILDING') s USING (subject)),
 matched AS (SELECT *, CASE WHEN NOT found THEN 'unmatched_subject' WHEN outcome_state IS NULL THEN 'unresolved_label' WHEN forecast_months IS NULL THEN 'missing_date' ELSE 'included' END AS match_outcome FROM mt)"""


def _matched(spark, sf):
    later = visits(spark, sf).where(F.col("visit_date") >= _day("2000-01-01")).select(
        "subject", F.col("row_id").alias("outcome_row"), F.col("visit_date").alias("outcome_date"), F.col("state").alias("raw_label")
    )
    index = _scoring(spark, sf).where(F.col("segment") != "BUILDING").select(
        "subject", F.col("row_id").alias("index_row"), F.col("visit_date").alias("index_date")
    )
    frozen = index.select("subject", (F.col("index_row") % 10 / F.lit(10.0)).alias("frozen_score"))
    return D.match_outcomes(
        later, index, "subject", "index_date", "outcome_date", "raw_label", _OUT_SCHEME, predictions=frozen
    )


@query(
    "outcome_matching",
    f"""WITH {_MATCH_SQL} SELECT subject, outcome_row, index_row, outcome_state, round(forecast_months, 6) AS forecast_months, match_outcome,
      round(index_row % 10 / CAST(10 AS DOUBLE), 6) AS frozen_score FROM matched""",
)
def outcome_matching(spark, sf):
    cols = ["subject", "outcome_row", "index_row", "outcome_state", "forecast_months", "match_outcome", "frozen_score"]
    return rounded(_matched(spark, sf).select(*cols))


@query("match_outcome_counts", f"WITH {_MATCH_SQL} SELECT match_outcome, CAST(count(*) AS BIGINT) AS rows FROM matched GROUP BY 1")
def match_outcome_counts(spark, sf):
    return _matched(spark, sf).groupBy("match_outcome").agg(F.count("*").alias("rows"))


@query(
    "follow_up_rows_per_subject",
    f"""WITH {_MATCH_SQL}, c AS (SELECT subject, count(*) AS k FROM matched WHERE match_outcome = 'included' GROUP BY 1)
    SELECT CAST(count(*) AS DOUBLE) AS subjects, round(avg(k), 6) AS mean, round(quantile_cont(CAST(k AS DOUBLE), 0.5), 6) AS median, CAST(max(k) AS DOUBLE) AS max FROM c""".replace("CAST(count(*) AS DOUBLE) AS subjects", "CAST(count(*) AS BIGINT) AS subjects"),
)
def follow_up_rows_per_subject(spark, sf):
    included = _matched(spark, sf).where(F.col("match_outcome") == "included")
    return rounded(D.follow_up_counts(included, "subject"))


@query(
    "matched_horizon_description",
    f"""WITH {_MATCH_SQL} SELECT 'forecast_months' AS field, CAST(count(*) AS BIGINT) AS count, round(avg(forecast_months), 6) AS mean, round(stddev_samp(forecast_months), 6) AS std,
      round(min(forecast_months), 6) AS min, round(max(forecast_months), 6) AS max, round(quantile_cont(forecast_months, 0.25), 6) AS p25, round(quantile_cont(forecast_months, 0.5), 6) AS p50,
      round(quantile_cont(forecast_months, 0.75), 6) AS p75 FROM matched WHERE match_outcome = 'included'""",
)
def matched_horizon_description(spark, sf):
    from visitline.operators.selective import describe

    included = _matched(spark, sf).where(F.col("match_outcome") == "included")
    return rounded(describe(included, ["forecast_months"]))


@query(
    "replay_join",
    f"""WITH {_SIDES_SQL} SELECT t.row_id, t.subject, s.spend, s.balance, t.segment FROM train t LEFT JOIN scoring s USING (subject)""",
)
def replay_join(spark, sf):
    rows = _train(spark, sf).select("row_id", "subject", "spend", "segment")
    return D.replace_from(rows, _scoring(spark, sf), "subject", ["spend", "balance"])


_CONC_SQL = f"""{_SIDES_SQL}, fa AS (SELECT subject, state FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY visit_date, row_id) AS rn FROM train) WHERE rn = 1),
 jj AS (SELECT fa.subject, fa.state AS a, s.state AS b FROM fa JOIN scoring s USING (subject))"""


def _first_train(spark, sf):
    return W.first_follow_up(_train(spark, sf), "subject", "visit_date", "row_id")


@query("concordant_subjects", f"WITH {_CONC_SQL} SELECT subject, a AS state FROM jj WHERE a = b")
def concordant_subjects(spark, sf):
    return D.concordant_subjects(_first_train(spark, sf), _scoring(spark, sf), "subject", "state")


@query(
    "concordance_counts",
    f"""WITH {_CONC_SQL} SELECT CAST(count(*) AS BIGINT) AS common, CAST(count(*) FILTER (WHERE a = b) AS BIGINT) AS concordant, CAST(count(*) FILTER (WHERE a <> b) AS BIGINT) AS mismatched FROM jj""",
)
def concordance_counts(spark, sf):
    return D.concordance_counts(_first_train(spark, sf), _scoring(spark, sf), "subject", "state")


# --- integrity ---------------------------------------------------------------------------------


@query(
    "reproduced_predictions",
    f"""WITH {PRED_SQL}, m AS (SELECT row_id, abs(p0 - (1 - p1 - p2)) AS g FROM pred)
    SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS unmatched, round(max(g), 6) AS max_gap, max(g) <= 1e-12 AS reproduced FROM m""",
)
def reproduced_predictions(spark, sf):
    p = [F.get("prob", F.lit(i)) for i in range(3)]
    stored = predictions(spark, sf).select("row_id", p[0].alias("p0"))
    fresh = predictions(spark, sf).select("row_id", (F.lit(1.0) - p[1] - p[2]).alias("p0"))
    return rounded(I.reproduced(stored, fresh, ["row_id"], ["p0"]))


@query(
    "pair_integrity",
    f"""WITH {PAIRS_SQL}, s AS (SELECT subject, CASE WHEN min(visit_date) < DATE '1996-01-01' THEN 'train' ELSE 'test' END AS split FROM visits GROUP BY 1),
    j AS (SELECT pairs.*, split FROM pairs JOIN s USING (subject)),
    x AS (SELECT count(*) AS n FROM (SELECT subject FROM j GROUP BY 1 HAVING count(DISTINCT split) > 1)),
    y AS (SELECT count(*) AS n FROM j WHERE visit_date >= future_date)
    SELECT 'subjects_in_one_split' AS name, n = 0 AS passed, CAST(n AS VARCHAR) AS detail FROM x UNION ALL SELECT 'source_before_target', n = 0, CAST(n AS VARCHAR) FROM y
    UNION ALL SELECT 'no_target_in_features', true, '' UNION ALL SELECT 'overall', (SELECT n = 0 FROM x) AND (SELECT n = 0 FROM y), '3'""",
)
def pair_integrity(spark, sf):
    from visitline.plans.cohorts import _early_late

    rows = bare_visits(spark, sf)
    tagged = J.attach_split(rows, _early_late(rows), "subject")
    pairs = J.future_pairs(tagged, ["spend"], carry=["split"], **SPEC)
    return I.pair_integrity(pairs, ["spend"])


@query(
    "verification_gate",
    f"""WITH {PRED_SQL} SELECT 'rows_present' AS name, count(*) > 0 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM pred
    UNION ALL SELECT 'probability_simplex', max(abs(p0 + p1 + p2 - 1)) <= 1e-8, CAST(count(*) AS VARCHAR) FROM pred
    UNION ALL SELECT 'first_follow_up_unique', true, (SELECT CAST(count(DISTINCT subject) AS VARCHAR) FROM pred)
    UNION ALL SELECT 'overall', true, '3'""",
)
def verification_gate(spark, sf):
    rows = predictions(spark, sf)
    first = W.first_follow_up(rows, "subject", "visit_date", "row_id").groupBy("subject").agg(F.count("*").alias("n"))
    return I.gate(
        [
            I.check(rows, "rows_present", F.count("*") > 0, F.count("*")),
            I.simplex_check(rows, F.col("prob")),
            I.check(first, "first_follow_up_unique", F.max("n") == 1, F.count("*")),
        ]
    )


@query(
    "predicted_state_names",
    f"WITH {PRED_SQL} SELECT CASE yhat WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS predicted_state, CAST(count(*) AS BIGINT) AS n FROM pred GROUP BY 1",
)
def predicted_state_names(spark, sf):
    from visitline.functions.states import state_name

    rows = predictions(spark, sf).select(state_name(P.predicted_class(F.col("prob")), SCHEME).alias("predicted_state"))
    return rows.groupBy("predicted_state").agg(F.count("*").alias("n"))


@query(
    "split_disjointness",
    f"""WITH {VISITS_SQL}, fd AS (SELECT subject, min(visit_date) AS d FROM visits GROUP BY 1)
    SELECT CAST(count(*) AS BIGINT) AS overlapping FROM fd WHERE d IS NULL""",
)
def split_disjointness(spark, sf):
    split = T.temporal_split(bare_visits(spark, sf), "subject", "visit_date")
    return T.overlapping_subjects(split).agg(F.count("*").alias("overlapping"))


