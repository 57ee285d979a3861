"""Queries: probability metrics, calibration, selective prediction, model choice and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitline.functions import probability as P
from visitline.functions.states import error_category, state_name
from visitline.operators import bootstrap as B, metrics as M, selective as V
from visitline.plans.registry import query, rounded
from visitline.plans.standins import (
    BINARY_SQL, PLACES_SQL, PRED_SQL, SCHEME, VISITS_SQL, bare_visits, binary_scores, hash_sql, predictions, table, visits,
)



def _prob():
    return F.col("prob")


def confusion_sql(source: str, by: str = "", extra: str = "") -> str:
    """Per-group confusion metrics written as plain grouped SQL over (y, yhat, p0, p1, p2)."""
    g = f"{by}, " if by else ""
    cells = ", ".join(
        f"CAST(count(*) FILTER (WHERE y = {i} AND yhat = {j}) AS DOUBLE) AS c{i}{j}" for i in range(3) for j in range(3)
    )
    sup = {k: f"(c{k}0 + c{k}1 + c{k}2)" for k in range(3)}
    cal = {k: f"(c0{k} + c1{k} + c2{k})" for k in range(3)}
    rec = {k: f"CASE WHEN {sup[k]} > 0 THEN c{k}{k} / {sup[k]} END" for k in range(3)}
    f1 = {k: f"CASE WHEN {sup[k]} + {cal[k]} > 0 THEN 2 * c{k}{k} / ({sup[k]} + {cal[k]}) END" for k in range(3)}
    mean = lambda d: "list_avg([" + ", ".join(d.values()) + "])"
    pe = "(" + " + ".join(f"{sup[k]} * {cal[k]}" for k in range(3)) + ") / (n * n)"
    per_class = ", ".join(
        f"round(CASE WHEN {cal[k]} > 0 THEN c{k}{k} / {cal[k]} ELSE 0 END, 6) AS precision_class_{k}, "
        f"round(coalesce({rec[k]}, 0), 6) AS recall_class_{k}, round(coalesce({f1[k]}, 0), 6) AS f1_class_{k}"
        for k in range(3)
    )
    return f"""cells AS (SELECT {g}{cells}, CAST(count(*) AS DOUBLE) AS n,
       avg(-ln(least(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS ll,
       avg(power(p0 - CASE WHEN y = 0 THEN 1 ELSE 0 END, 2) + power(p1 - CASE WHEN y = 1 THEN 1 ELSE 0 END, 2) + power(p2 - CASE WHEN y = 2 THEN 1 ELSE 0 END, 2)) AS br
       FROM {source} {f'GROUP BY {by}' if by else ''}),
    met AS (SELECT {g}n AS n_rows, round((c00 + c11 + c22) / n, 6) AS accuracy, round({mean(rec)}, 6) AS balanced_accuracy,
       round({mean(f1)}, 6) AS macro_f1, round(((c00 + c11 + c22) / n - {pe}) / (1 - {pe}), 6) AS cohen_kappa,
       round(ll, 6) AS log_loss, round(br, 6) AS brier_score, {per_class},
       '[[' || CAST(c00 AS BIGINT) || ',' || CAST(c01 AS BIGINT) || ',' || CAST(c02 AS BIGINT) || '],[' || CAST(c10 AS BIGINT) || ',' ||
       CAST(c11 AS BIGINT) || ',' || CAST(c12 AS BIGINT) || '],[' || CAST(c20 AS BIGINT) || ',' || CAST(c21 AS BIGINT) || ',' || CAST(c22 AS BIGINT) || ']]' AS confusion_matrix
       FROM cells)"""


def auc_sql(source: str, by: str = "") -> str:
    """Mid-rank (Mann-Whitney) AUC per class and group, macro-averaged."""
    g = f"{by}, " if by else ""
    lane = f"PARTITION BY {g}k ORDER BY s"
    using = f"GROUP BY {by}" if by else ""
    return f"""longp AS (SELECT {g}y, 0 AS k, p0 AS s FROM {source} UNION ALL SELECT {g}y, 1, p1 FROM {source} UNION ALL SELECT {g}y, 2, p2 FROM {source}),
    ranked AS (SELECT {g}y, k, s, rank() OVER ({lane}) + (count(*) OVER (PARTITION BY {g}k, s) - 1) / CAST(2 AS DOUBLE) AS r FROM longp),
    perk AS (SELECT {g}k, sum(r) FILTER (WHERE y = k) AS rs, CAST(count(*) FILTER (WHERE y = k) AS DOUBLE) AS np, CAST(count(*) FILTER (WHERE y <> k) AS DOUBLE) AS nn
             FROM ranked GROUP BY {g}k),
    auc AS (SELECT {g}round(avg((rs - np * (np + 1) / 2) / (np * nn)), 6) AS roc_auc_ovr FROM perk {using})"""


def _json_matrix(df):
    return df.withColumn("confusion_matrix", F.to_json("confusion_matrix"))


@query("multiclass_metrics", f"WITH {PRED_SQL}, {confusion_sql('pred')}, {auc_sql('pred')} SELECT * FROM met, auc")
def multiclass_metrics(spark, sf):
    return rounded(_json_matrix(M.multiclass_metrics(predictions(spark, sf), "y", "prob")))


@query(
    "multiclass_metrics_by_split",
    f"WITH {PRED_SQL}, {confusion_sql('pred', 'split')}, {auc_sql('pred', 'split')} SELECT * FROM met JOIN auc USING (split)",
)
def multiclass_metrics_by_split(spark, sf):
    return rounded(_json_matrix(M.multiclass_metrics(predictions(spark, sf), "y", "prob", by=["split"])))


_TWO_SQL = f"""WITH {PRED_SQL}, two AS (SELECT CASE WHEN visit_date < DATE '1997-01-01' THEN 'one' ELSE 'two' END AS part, y, p1 AS s FROM pred
   WHERE (visit_date < DATE '1997-01-01' AND y = 1) OR (visit_date >= DATE '1997-01-01' AND y IN (0, 2))),
 r AS (SELECT part, y, rank() OVER (PARTITION BY part ORDER BY s) + (count(*) OVER (PARTITION BY part, s) - 1) / CAST(2 AS DOUBLE) AS r FROM two),
 a AS (SELECT part, sum(r) FILTER (WHERE y = 2) AS rs, CAST(count(*) FILTER (WHERE y = 2) AS DOUBLE) AS np, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS nn FROM r GROUP BY 1)
 SELECT part, CASE WHEN np > 0 AND nn > 0 THEN round((rs - np * (np + 1) / 2) / (np * nn), 6) END AS roc_auc_ovr FROM a"""


@query("auc_with_absent_classes", _TWO_SQL)
def auc_with_absent_classes(spark, sf):
    early = F.col("visit_date") < F.lit("1997-01-01").cast("date")
    rows = predictions(spark, sf).withColumn("part", F.when(early, "one").otherwise("two"))
    kept = rows.where((early & (F.col("y") == 1)) | (~early & F.col("y").isin(0, 2)))
    return rounded(M.auc_ovr(kept, "y", _prob(), [0, 1, 2], ["part"]))


def _binary_sql(by: str = "") -> str:
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    join = f"JOIN auc USING ({by}) JOIN ap USING ({by})" if by else ", auc, ap"
    return f"""c AS (SELECT {g}CAST(count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE y = 1 AND score < 0.5) AS DOUBLE) AS fn,
      CAST(count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE y = 0 AND score < 0.5) AS DOUBLE) AS tn,
      CAST(count(*) AS BIGINT) AS n_rows, avg(power(score - y, 2)) AS br,
      avg(-ln(least(greatest(CASE WHEN y = 1 THEN score ELSE 1 - score END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS ll FROM scores {grp}),
    r AS (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {g}score) - 1) / CAST(2 AS DOUBLE) AS rk FROM scores),
    auc AS (SELECT {g}(sum(rk) FILTER (WHERE y = 1) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))) AS roc_auc FROM r {grp}),
    pts AS (SELECT {g}score, sum(y) AS pos, count(*) AS n FROM scores GROUP BY {g}score),
    cum AS (SELECT {g}pos, CAST(sum(pos) OVER ({part} ORDER BY score DESC) AS DOUBLE) AS ctp, CAST(sum(n) OVER ({part} ORDER BY score DESC) AS DOUBLE) AS cn,
      CAST(sum(pos) OVER ({part}) AS DOUBLE) AS total FROM pts),
    ap AS (SELECT {g}sum(pos / total * ctp / cn) AS pr_auc FROM cum {grp})
    SELECT {g}n_rows, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
      round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1,
      round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn), 6) AS npv,
      round(br, 6) AS brier_score, round(ll, 6) AS log_loss FROM c {join}"""


@query("binary_metrics", f"WITH {BINARY_SQL}, {_binary_sql()}")
def binary_metrics(spark, sf):
    return rounded(M.binary_metrics(binary_scores(spark, sf), "y", "score"))


@query("binary_metrics_by_part", f"WITH {BINARY_SQL}, {_binary_sql('part')}")
def binary_metrics_by_part(spark, sf):
    return rounded(M.binary_metrics(binary_scores(spark, sf), "y", "score", by=["part"]))


@query(
    "roc_points",
    f"""WITH {PRED_SQL}, l AS (SELECT y, 0 AS class_id, p0 AS s FROM pred UNION ALL SELECT y, 1, p1 FROM pred UNION ALL SELECT y, 2, p2 FROM pred),
    g AS (SELECT class_id, s, count(*) FILTER (WHERE y = class_id) AS pos, count(*) FILTER (WHERE y <> class_id) AS neg FROM l GROUP BY 1, 2)
    SELECT CAST(class_id AS INTEGER) AS class_id, round(s, 6) AS threshold,
      round(sum(neg) OVER (PARTITION BY class_id ORDER BY s DESC) / CAST(sum(neg) OVER (PARTITION BY class_id) AS DOUBLE), 6) AS fpr,
      round(sum(pos) OVER (PARTITION BY class_id ORDER BY s DESC) / CAST(sum(pos) OVER (PARTITION BY class_id) AS DOUBLE), 6) AS tpr FROM g""",
)
def roc_points(spark, sf):
    return rounded(M.roc_points(predictions(spark, sf), "y", _prob(), [0, 1, 2]))


_LONG_SQL = """l AS (SELECT split, y, 0 AS class_id, p0 AS s FROM pred UNION ALL SELECT split, y, 1, p1 FROM pred UNION ALL SELECT split, y, 2, p2 FROM pred)"""


@query(
    "calibration_bins",
    f"""WITH {PRED_SQL}, {_LONG_SQL} SELECT split, CAST(class_id AS INTEGER) AS class_id, CAST(least(floor(s * 10), 9) AS INTEGER) AS bin,
      CAST(count(*) AS BIGINT) AS n, round(avg(s), 6) AS mean_predicted, round(avg(CASE WHEN y = class_id THEN 1.0 ELSE 0.0 END), 6) AS observed_rate
    FROM l GROUP BY 1, 2, 3""",
)
def calibration_bins(spark, sf):
    return rounded(M.calibration_bins(predictions(spark, sf), "y", _prob(), ["split"]))


_EDGES = "(VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) t(i)"
_IN_BIN = "s > i * CAST(0.1 AS DOUBLE) AND s <= CASE WHEN i = 9 THEN 1.0 ELSE (i + 1) * CAST(0.1 AS DOUBLE) END"


@query(
    "expected_calibration_error",
    f"""WITH {PRED_SQL}, b AS (SELECT split, i, count(*) AS n, avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) AS acc, avg(s) AS conf
      FROM (SELECT split, y, yhat, conf AS s FROM pred) q JOIN {_EDGES} ON {_IN_BIN} GROUP BY 1, 2),
    t AS (SELECT split, CAST(count(*) AS DOUBLE) AS total FROM pred GROUP BY 1)
    SELECT split, round(sum(n / total * abs(acc - conf)), 6) AS ece FROM b JOIN t USING (split) GROUP BY 1""",
)
def expected_calibration_error(spark, sf):
    return rounded(M.expected_calibration_error(predictions(spark, sf), "y", _prob(), ["split"]))


@query(
    "classwise_calibration_error",
    f"""WITH {PRED_SQL}, {_LONG_SQL}, b AS (SELECT split, class_id, i, count(*) AS n, avg(CASE WHEN y = class_id THEN 1.0 ELSE 0.0 END) AS acc, avg(s) AS conf
      FROM l JOIN {_EDGES} ON {_IN_BIN} GROUP BY 1, 2, 3),
    t AS (SELECT split, CAST(count(*) AS DOUBLE) AS total FROM pred GROUP BY 1)
    SELECT split, CAST(class_id AS INTEGER) AS class_id, round(sum(n / total * abs(acc - conf)), 6) AS classwise_ece FROM b JOIN t USING (split) GROUP BY 1, 2""",
)
def classwise_calibration_error(spark, sf):
    return rounded(M.classwise_calibration_error(predictions(spark, sf), "y", _prob(), ["split"]))


_UNC_SQL = f"""{PRED_SQL}, u AS (SELECT row_id, split, conf AS max_probability, -(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) AS predictive_entropy,
   conf - (p0 + p1 + p2 - conf - least(p0, p1, p2)) AS probability_margin FROM pred)"""


@query(
    "uncertainty_measures",
    f"WITH {_UNC_SQL} SELECT row_id, round(max_probability, 6) AS max_probability, round(predictive_entropy, 6) AS predictive_entropy, round(probability_margin, 6) + 0.0 AS probability_margin FROM u",
)
def uncertainty_measures(spark, sf):
    measured = M.uncertainty_measures(predictions(spark, sf), _prob())
    return rounded(measured.select("row_id", "max_probability", "predictive_entropy", "probability_margin"))


@query(
    "uncertainty_summary",
    f"""WITH {_UNC_SQL} SELECT split, 'max_probability' AS measure, round(avg(max_probability), 6) AS mean, round(stddev_samp(max_probability), 6) AS std FROM u GROUP BY 1
    UNION ALL SELECT split, 'predictive_entropy', round(avg(predictive_entropy), 6), round(stddev_samp(predictive_entropy), 6) FROM u GROUP BY 1
    UNION ALL SELECT split, 'probability_margin', round(avg(probability_margin), 6), round(stddev_samp(probability_margin), 6) FROM u GROUP BY 1""",
)
def uncertainty_summary(spark, sf):
    return rounded(M.uncertainty_summary(M.uncertainty_measures(predictions(spark, sf), _prob()), ["split"]))


COVERAGES = [1.0, 0.9, 0.8, 0.7, 0.5]
_TH_SQL = f"""{PRED_SQL}, th AS (SELECT c AS target_coverage, (SELECT quantile_cont(conf, q) FROM pred WHERE split = 'validation') AS threshold FROM
  (SELECT CAST(1.0 AS DOUBLE) AS c, 0 AS z) LIMIT 0),
 thresholds AS ({' UNION ALL '.join(f"SELECT CAST({c} AS DOUBLE) AS target_coverage, quantile_cont(conf, {round(1 - c, 10)}) AS threshold FROM pred WHERE split = 'validation'" for c in COVERAGES)})"""
_TH_SQL = _TH_SQL.replace(_TH_SQL[_TH_SQL.index("th AS"):_TH_SQL.index("thresholds AS")], "")


@query("coverage_thresholds", f"WITH {_TH_SQL} SELECT target_coverage, round(threshold, 6) AS threshold FROM thresholds")
def coverage_thresholds(spark, sf):
    rows = predictions(spark, sf).where(F.col("split") == "validation")
    return rounded(V.coverage_thresholds(rows, _prob(), COVERAGES))


def _thresholds(spark, sf):
    # Rounded so that a quantile landing exactly on a score compares alike in both engines.
    rows = predictions(spark, sf).where(F.col("split") == "validation")
    return V.coverage_thresholds(rows, _prob(), COVERAGES).withColumn("threshold", F.round("threshold", 6) - F.lit(1e-9))


_RC_SQL = f"""{_TH_SQL}, rth AS (SELECT target_coverage, round(threshold, 6) - 1e-9 AS threshold FROM thresholds),
 kept AS (SELECT pred.*, target_coverage, threshold FROM pred JOIN rth ON conf >= threshold),
 {confusion_sql('kept', 'split, target_coverage, threshold')}, tot AS (SELECT split, CAST(count(*) AS DOUBLE) AS total FROM pred GROUP BY 1),
 rc AS (SELECT split, target_coverage, round(n_rows / total, 6) AS coverage, round(threshold, 6) AS threshold, CAST(n_rows AS BIGINT) AS n_retained,
   accuracy, balanced_accuracy, macro_f1, round(1 - accuracy, 6) AS error_rate FROM met JOIN tot USING (split))"""


def _risk_coverage(spark, sf):
    return rounded(V.risk_coverage(predictions(spark, sf), "y", _prob(), _thresholds(spark, sf)))


@query("risk_coverage", f"WITH {_RC_SQL} SELECT * FROM rc")
def risk_coverage(spark, sf):
    return _risk_coverage(spark, sf)


@query(
    "threshold_selection",
    f"WITH {_RC_SQL} SELECT * FROM rc WHERE split = 'validation' AND coverage >= 0.7 ORDER BY macro_f1 DESC, coverage DESC LIMIT 1",
)
def threshold_selection(spark, sf):
    return V.select_threshold(_risk_coverage(spark, sf))


@query(
    "selective_replay",
    f"""WITH {PRED_SQL}, tagged AS (SELECT *, 'all' AS analysis FROM pred UNION ALL SELECT *, 'selective' FROM pred WHERE conf >= 0.55),
    {confusion_sql('tagged', 'analysis')}, {auc_sql('tagged', 'analysis')}
    SELECT *, round(n_rows / (SELECT max(n_rows) FROM met), 6) AS coverage FROM met JOIN auc USING (analysis)""",
)
def selective_replay(spark, sf):
    return rounded(_json_matrix(V.selective_replay(predictions(spark, sf), "y", _prob(), 0.55)))


@query("abstention", f"WITH {PRED_SQL} SELECT row_id, round(conf, 6) AS confidence, NOT (conf >= 0.55) AS abstained FROM pred")
def abstention(spark, sf):
    from visitline.operators.selection import with_abstention

    rows = predictions(spark, sf).select("row_id", P.confidence(_prob()).alias("confidence"))
    return rounded(with_abstention(rows, "confidence", 0.55))


_BINS_SQL = """CASE WHEN m > 0 AND m <= 12 THEN '0-12 months' WHEN m > 12 AND m <= 24 THEN '12-24 months'
   WHEN m > 24 AND m <= 36 THEN '24-36 months' WHEN m > 36 THEN '>36 months' END"""
_SCOPE_SQL = f"""{PRED_SQL}, dated AS (SELECT *, date_diff('day', DATE '1996-01-01', visit_date) / 30.4375 AS m,
   row_number() OVER (PARTITION BY subject ORDER BY visit_date, row_id) AS rn FROM pred),
 scoped AS (SELECT *, 'row_level' AS scope, 'overall' AS horizon FROM dated UNION ALL SELECT *, 'first_follow_up', 'overall' FROM dated WHERE rn = 1
   UNION ALL SELECT *, 'horizon', {_BINS_SQL} FROM dated),
 listed AS (SELECT * FROM (VALUES ('row_level', 'overall'), ('first_follow_up', 'overall'), ('horizon', '0-12 months'), ('horizon', '12-24 months'),
   ('horizon', '24-36 months'), ('horizon', '>36 months')) t(scope, horizon)),
 subs AS (SELECT scope, horizon, CAST(count(DISTINCT subject) AS BIGINT) AS n_subjects FROM scoped GROUP BY 1, 2)"""


@query(
    "scoped_evaluation",
    f"""WITH {_SCOPE_SQL}, {confusion_sql('scoped', 'scope, horizon')}, {auc_sql('scoped', 'scope, horizon')}
    SELECT scope, horizon, CAST(coalesce(n_rows, 0) AS BIGINT) AS n_rows, CAST(coalesce(n_subjects, 0) AS BIGINT) AS n_subjects,
      coalesce(n_rows >= 20, false) AS stable_metrics_reported, accuracy, balanced_accuracy, macro_f1, cohen_kappa, log_loss, brier_score,
      {', '.join(f'precision_class_{k}, recall_class_{k}, f1_class_{k}' for k in range(3))}, confusion_matrix, roc_auc_ovr
    FROM listed LEFT JOIN met USING (scope, horizon) LEFT JOIN auc USING (scope, horizon) LEFT JOIN subs USING (scope, horizon)""",
)
def scoped_evaluation(spark, sf):
    day = lambda d: F.lit(d).cast("date")
    rows = predictions(spark, sf).withColumn("forecast_months", F.datediff("visit_date", day("1996-01-01")) / F.lit(30.4375))
    return rounded(_json_matrix(V.scoped_evaluation(rows, "y", "prob", "subject", "visit_date", "row_id")))


@query(
    "scoped_evaluation_of_calls",
    f"""WITH {_SCOPE_SQL}, called AS (SELECT * REPLACE (CASE WHEN p1 >= 0.3 THEN 1 ELSE yhat END AS yhat) FROM scoped),
    {confusion_sql('called', 'scope, horizon')}, {auc_sql('called', 'scope, horizon')}
    SELECT scope, horizon, CAST(coalesce(n_rows, 0) AS BIGINT) AS n_rows, accuracy, balanced_accuracy, macro_f1, log_loss, confusion_matrix, roc_auc_ovr
    FROM listed LEFT JOIN met USING (scope, horizon) LEFT JOIN auc USING (scope, horizon)""",
)
def scoped_evaluation_of_calls(spark, sf):
    rows = predictions(spark, sf).withColumn("forecast_months", F.datediff("visit_date", F.lit("1996-01-01").cast("date")) / F.lit(30.4375))
    call = F.when(F.get("prob", 1) >= 0.3, 1).otherwise(P.predicted_class(F.col("prob")))
    scored = V.scoped_evaluation(rows, "y", "prob", "subject", "visit_date", "row_id", predicted=call)
    kept = ["scope", "horizon", "n_rows", "accuracy", "balanced_accuracy", "macro_f1", "log_loss", "confusion_matrix", "roc_auc_ovr"]
    return rounded(_json_matrix(scored).select(*kept))


def _bootstrap_sql(source: str, repetitions: int) -> str:
    """Draws, their counts per (repetition, truth, call, probabilities) and percentile intervals."""
    names = ("accuracy", "balanced_accuracy", "macro_f1", "roc_auc_ovr", "log_loss", "brier_score")
    cell = lambda i, j: f"sum(w) FILTER (WHERE y = {i} AND yhat = {j})"
    total = lambda cells: " + ".join(f"coalesce({c}, 0)" for c in cells)
    sup = {k: "(" + total(cell(k, j) for j in range(3)) + ")" for k in range(3)}
    cal = {k: "(" + total(cell(i, k) for i in range(3)) + ")" for k in range(3)}
    hit = {k: f"coalesce({cell(k, k)}, 0)" for k in range(3)}
    mean = lambda num, den: "list_avg([" + ", ".join(f"CASE WHEN {den(k)} > 0 THEN {num(k)} / CAST({den(k)} AS DOUBLE) END" for k in range(3)) + "])"
    own = "least(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"
    brier = " + ".join(f"power(p{k} - CASE WHEN y = {k} THEN 1 ELSE 0 END, 2)" for k in range(3))
    scores = " UNION ALL ".join(f"SELECT rep, y, w, {k} AS k, p{k} AS s FROM sums" for k in range(3))
    return f"""WITH {PRED_SQL}, {PLACES_SQL}, source AS ({source}),
    draws AS (SELECT rep, CAST('0x' || left(md5('42:' || rep || ':' || position), 15) AS BIGINT) % n AS position FROM places, range(1, {repetitions + 1}) t(rep)),
    times AS (SELECT rep, position, count(*) AS times FROM draws GROUP BY 1, 2),
    merged AS (SELECT position, y, yhat, p0, p1, p2, count(*) AS same FROM source JOIN places USING (subject) GROUP BY ALL),
    sums AS (SELECT rep, y, yhat, p0, p1, p2, CAST(sum(times * same) AS BIGINT) AS w FROM times JOIN merged USING (position) GROUP BY ALL
      UNION ALL SELECT 0, y, yhat, p0, p1, p2, count(*) FROM source GROUP BY ALL),
    flat AS (SELECT rep, ({total(cell(k, k) for k in range(3))}) / CAST(sum(w) AS DOUBLE) AS accuracy,
      {mean(lambda k: hit[k], lambda k: sup[k])} AS balanced_accuracy,
      {mean(lambda k: f"2 * {hit[k]}", lambda k: f"({sup[k]} + {cal[k]})")} AS macro_f1,
      sum(w * -ln({own})) / sum(w) AS log_loss, sum(w * ({brier})) / sum(w) AS brier_score FROM sums GROUP BY rep),
    ties AS (SELECT rep, k, s, CAST(sum(CASE WHEN y = k THEN w ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN y <> k THEN w ELSE 0 END) AS DOUBLE) AS neg FROM ({scores}) GROUP BY ALL),
    below AS (SELECT *, sum(neg) OVER (PARTITION BY rep, k ORDER BY s) - neg AS less FROM ties),
    auc AS (SELECT rep, avg(a) AS roc_auc_ovr FROM (SELECT rep, k, sum(pos * (less + neg / 2)) / (sum(pos) * sum(neg)) AS a FROM below GROUP BY rep, k) GROUP BY rep),
    long AS (UNPIVOT (SELECT * FROM flat JOIN auc USING (rep)) ON {", ".join(names)} INTO NAME metric VALUE v)
    SELECT metric, round(max(v) FILTER (WHERE rep = 0), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (WHERE rep > 0), 6) AS ci_lower,
      round(quantile_cont(v, 0.975) FILTER (WHERE rep > 0), 6) AS ci_upper, count(v) FILTER (WHERE rep > 0) AS valid_repetitions, 'subject' AS bootstrap_unit
    FROM long GROUP BY metric"""


@query("bootstrap_intervals", _bootstrap_sql("SELECT subject, y, yhat, p0, p1, p2 FROM pred", 1000))
def bootstrap_intervals(spark, sf):
    return rounded(B.subject_bootstrap_ci(predictions(spark, sf), "subject", "y", _prob()))


@query(
    "bootstrap_called_intervals",
    _bootstrap_sql("SELECT subject, y, CASE WHEN p2 >= 0.3 THEN 2 ELSE yhat END AS yhat, p0, p1, p2 FROM pred", 200),
)
def bootstrap_called_intervals(spark, sf):
    called = F.when(F.get("prob", F.lit(2)) >= 0.3, 2).otherwise(P.predicted_class(_prob()))
    return rounded(B.subject_bootstrap_ci(predictions(spark, sf), "subject", "y", _prob(), 200, predicted=called))


@query(
    "resampled_blocks",
    f"""WITH {PLACES_SQL}, picked AS (SELECT CAST('0x' || left(md5('42:1:' || position), 15) AS BIGINT) % n AS position, count(*) AS times FROM places GROUP BY 1)
    SELECT subject, CAST(o_orderdate AS DATE) AS visit_date, o_orderstatus AS state, o_orderkey AS row_id, o_totalprice AS spend, copy
    FROM (SELECT *, unnest(range(1, times + 1)) AS copy FROM picked) JOIN places USING (position) JOIN orders ON o_custkey = subject""",
)
def resampled_blocks(spark, sf):
    return B.resample_blocks(bare_visits(spark, sf), "subject", seed=42)


@query(
    "soft_voting",
    f"""WITH {PRED_SQL}, m AS (SELECT row_id, 0.6 * p0 + 0.3 * p1 + 0.1 * p2 AS a, 0.6 * p1 + 0.3 * p2 + 0.1 * p0 AS b, 0.6 * p2 + 0.3 * p0 + 0.1 * p1 AS c FROM pred)
    SELECT row_id, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM m""",
)
def soft_voting(spark, sf):
    p = [F.get(_prob(), F.lit(i)) for i in range(3)]
    members = [_prob(), F.array(p[1], p[2], p[0]), F.array(p[2], p[0], p[1])]
    rows = predictions(spark, sf).select("row_id", P.soft_vote(members, [6, 3, 1]).alias("v"))
    return rounded(rows.select("row_id", *[F.get("v", F.lit(i)).alias(f"p{i}") for i in range(3)]))


@query(
    "calibration_renormalization",
    f"""WITH {PRED_SQL}, c AS (SELECT row_id, p0, p1, p2, CASE WHEN p0 > 0.2 THEN p0 ELSE 0 END AS a, CASE WHEN p1 > 0.5 THEN p1 ELSE 0 END AS b, CASE WHEN p2 > 0.4 THEN p2 ELSE 0 END AS d FROM pred)
    SELECT row_id, round(CASE WHEN a + b + d <= 0 THEN p0 ELSE a / (a + b + d) END, 6) AS q0, round(CASE WHEN a + b + d <= 0 THEN p1 ELSE b / (a + b + d) END, 6) AS q1,
      round(CASE WHEN a + b + d <= 0 THEN p2 ELSE d / (a + b + d) END, 6) AS q2 FROM c""",
)
def calibration_renormalization(spark, sf):
    p = [F.get(_prob(), F.lit(i)) for i in range(3)]
    cut = F.array(*[F.when(x > t, x).otherwise(0.0) for x, t in zip(p, (0.2, 0.5, 0.4))])
    rows = predictions(spark, sf).select("row_id", P.calibrated_or_base(cut, _prob()).alias("q"))
    return rounded(rows.select("row_id", *[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(3)]))


@query(
    "simplex_check",
    f"""WITH {PRED_SQL} SELECT split, CAST(count(*) AS BIGINT) AS n, max(abs(p0 + p1 + p2 - 1)) <= 1e-8 AS passed FROM pred GROUP BY 1""",
)
def simplex_check(spark, sf):
    rows = predictions(spark, sf)
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), (F.max(P.off_simplex(_prob())) <= 1e-8).alias("passed")
    )


@query(
    "one_hot_brier_terms",
    f"""WITH {PRED_SQL} SELECT future_state, round(avg(power(p0 - CASE WHEN y = 0 THEN 1 ELSE 0 END, 2) + power(p1 - CASE WHEN y = 1 THEN 1 ELSE 0 END, 2)
      + power(p2 - CASE WHEN y = 2 THEN 1 ELSE 0 END, 2)), 6) AS brier FROM pred GROUP BY 1""",
)
def one_hot_brier_terms(spark, sf):
    rows = predictions(spark, sf)
    return rounded(rows.groupBy("future_state").agg(F.avg(P.brier(_prob(), F.col("y"))).alias("brier")))


# --- error tables ------------------------------------------------------------------------------

# The source state of an error row: the status implied by the value of the order.
_SOURCE_SQL = "CASE WHEN spend < 160000 THEN 'F' WHEN spend < 330000 THEN 'O' ELSE 'P' END"
_ERR_SQL = f"""{PRED_SQL}, ep AS (SELECT *, {_SOURCE_SQL} AS source_state, CASE yhat WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS predicted_state FROM pred)"""


def _with_errors(spark, sf):
    source = F.when(F.col("spend") < 160000, "F").when(F.col("spend") < 330000, "O").otherwise("P")
    return (
        predictions(spark, sf)
        .withColumns({"source_state": source, "yhat": P.predicted_class(_prob()), "confidence": P.confidence(_prob())})
        .withColumn("predicted_state", state_name(F.col("yhat"), SCHEME))
    )


@query(
    "error_groups",
    f"""WITH {_ERR_SQL}
    SELECT 'O_to_P_missed_conversions' AS error_group, CAST(count(*) AS BIGINT) AS rows FROM ep WHERE source_state = 'O' AND future_state = 'P' AND predicted_state <> 'P'
    UNION ALL SELECT 'O_to_O_false_progression', CAST(count(*) AS BIGINT) FROM ep WHERE source_state = 'O' AND future_state = 'O' AND predicted_state = 'P'
    UNION ALL SELECT 'F_progression_missed', CAST(count(*) AS BIGINT) FROM ep WHERE source_state = 'F' AND future_state IN ('O', 'P') AND predicted_state = 'F'
    UNION ALL SELECT 'P_non_P_reversions', CAST(count(*) AS BIGINT) FROM ep WHERE source_state = 'P' AND future_state <> 'P'""",
)
def error_groups(spark, sf):
    return V.error_group_counts(_with_errors(spark, sf), "source_state", "future_state", "predicted_state", SCHEME)


@query(
    "error_categories",
    f"""WITH {_ERR_SQL} SELECT CASE WHEN y = 0 AND yhat = 2 THEN 'F_predicted_as_P' WHEN y = 2 AND yhat = 0 THEN 'P_predicted_as_F'
      WHEN y = 1 OR yhat = 1 THEN 'O_confusion' ELSE 'other_error' END AS error_category, CAST(count(*) AS BIGINT) AS count FROM ep WHERE y <> yhat GROUP BY 1""",
)
def error_categories(spark, sf):
    errors = _with_errors(spark, sf).where(F.col("y") != F.col("yhat"))
    tagged = errors.withColumn("error_category", error_category(F.col("y"), F.col("yhat"), SCHEME))
    return tagged.groupBy("error_category").agg(F.count("*").alias("count"))


@query(
    "confusion_counts",
    f"WITH {PRED_SQL} SELECT CAST(y AS INTEGER) AS y, CAST(yhat AS INTEGER) AS yhat, CAST(count(*) AS BIGINT) AS count FROM pred GROUP BY 1, 2",
)
def confusion_counts(spark, sf):
    return _with_errors(spark, sf).groupBy("y", "yhat").agg(F.count("*").alias("count")).orderBy(F.desc("count"))


@query(
    "error_distribution",
    f"""WITH {_ERR_SQL}, e AS (SELECT * FROM ep WHERE y <> yhat)
    SELECT 'future_state' AS field, future_state AS value, CAST(count(*) AS BIGINT) AS count FROM e GROUP BY 2
    UNION ALL SELECT 'source_state', source_state, CAST(count(*) AS BIGINT) FROM e GROUP BY 2""",
)
def error_distribution(spark, sf):
    errors = _with_errors(spark, sf).where(F.col("y") != F.col("yhat"))
    return V.error_distribution(errors, ["future_state", "source_state"])


@query(
    "error_description",
    f"""WITH {_ERR_SQL}, e AS (SELECT 'confidence' AS field, conf AS v FROM ep WHERE y <> yhat UNION ALL SELECT 'spend', spend FROM ep WHERE y <> yhat)
    SELECT field, CAST(count(*) AS BIGINT) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
      round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75 FROM e GROUP BY 1""",
)
def error_description(spark, sf):
    errors = _with_errors(spark, sf).where(F.col("y") != F.col("yhat"))
    return rounded(V.describe(errors, ["confidence", "spend"]))


@query(
    "confident_errors",
    f"WITH {_ERR_SQL} SELECT row_id, source_state, future_state, predicted_state, round(conf, 6) AS confidence FROM ep WHERE y <> yhat AND conf >= 0.6",
)
def confident_errors(spark, sf):
    errors = _with_errors(spark, sf).where(F.col("y") != F.col("yhat"))
    return rounded(
        V.confident_errors(errors, "confidence", 0.6, "row_id").select(
            "row_id", "source_state", "future_state", "predicted_state", "confidence"
        )
    )


# --- result tables: one "run" per (segment = model, priority = ablation, order year = seed) -----

_RUNS_SQL = f"""{VISITS_SQL}, runs AS (SELECT segment AS model, coalesce(priority, 'none') AS ablation, CAST(year(visit_date) AS INTEGER) AS seed,
   round(avg(CASE WHEN state = 'P' THEN 1.0 ELSE 0.0 END), 3) AS macro_f1, round(avg(spend) / 100000, 4) AS log_loss, round(avg(CASE WHEN state = 'O' THEN 1.0 ELSE 0.0 END), 4) AS brier_score,
   round(avg(CASE WHEN state = 'F' THEN 1.0 ELSE 0.0 END), 4) AS pr_auc, round(avg(balance) / 10000, 4) AS balanced_accuracy FROM visits GROUP BY 1, 2, 3)"""


def _runs(spark, sf):
    share = lambda s: F.avg((F.col("state") == s).cast("double"))
    return visits(spark, sf).groupBy(
        F.col("segment").alias("model"), F.coalesce("priority", F.lit("none")).alias("ablation"), F.year("visit_date").alias("seed")
    ).agg(
        F.round(share("P"), 3).alias("macro_f1"),
        F.round(F.avg("spend") / 100000, 4).alias("log_loss"),
        F.round(share("O"), 4).alias("brier_score"),
        F.round(share("F"), 4).alias("pr_auc"),
        F.round(F.avg("balance") / 10000, 4).alias("balanced_accuracy"),
    )


_RANKS = {"MACHINERY": 0, "HOUSEHOLD": 1, "FURNITURE": 2, "BUILDING": 3}
_RANK_SQL = "CASE model WHEN 'MACHINERY' THEN 0 WHEN 'HOUSEHOLD' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'BUILDING' THEN 3 ELSE 99 END"


@query(
    "model_selection",
    f"""WITH {_RUNS_SQL}, r AS (SELECT model, round(macro_f1, 1) AS macro_f1, round(log_loss, 0) AS log_loss, 0.0::DOUBLE AS brier_score, max(pr_auc) AS pr_auc FROM runs GROUP BY ALL)
    SELECT model, macro_f1, log_loss FROM r ORDER BY macro_f1 DESC, log_loss, brier_score, {_RANK_SQL} LIMIT 1""",
)
def model_selection(spark, sf):
    """Coarse scores tie, so that the simpler model is taken."""
    coarse = _runs(spark, sf).groupBy("model", F.round("macro_f1", 1).alias("macro_f1"), F.round("log_loss", 0).alias("log_loss")).agg(F.lit(0.0).alias("brier_score"))
    return V.select_model(coarse, _RANKS).select("model", "macro_f1", "log_loss")


@query(
    "landmark_model_selection",
    f"""WITH {_RUNS_SQL} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY pr_auc DESC, balanced_accuracy DESC, brier_score) AS rn FROM runs) WHERE rn = 1""",
)
def landmark_model_selection(spark, sf):
    runs = _runs(spark, sf).withColumnRenamed("seed", "horizon_months")
    return V.select_landmark_models(runs).withColumnRenamed("horizon_months", "seed")


@query("hazard_model_selection", f"WITH {_RUNS_SQL} SELECT * FROM runs ORDER BY log_loss, pr_auc DESC LIMIT 1")
def hazard_model_selection(spark, sf):
    return V.select_hazard_model(_runs(spark, sf))


@query("calibration_selection", f"WITH {_RUNS_SQL} SELECT * FROM runs ORDER BY log_loss, brier_score LIMIT 1")
def calibration_selection(spark, sf):
    return V.select_calibration(_runs(spark, sf))


@query(
    "tolerance_selection",
    f"""WITH {_RUNS_SQL} SELECT * FROM runs WHERE macro_f1 >= (SELECT max(macro_f1) FROM runs) - 0.05 ORDER BY {_RANK_SQL}, macro_f1 DESC, log_loss, brier_score LIMIT 1""",
)
def tolerance_selection(spark, sf):
    return V.select_within_tolerance(_runs(spark, sf), 0.05, _RANKS)


@query(
    "best_validation_run",
    f"WITH {_RUNS_SQL}, r AS (SELECT *, model || ablation || seed AS run FROM runs) SELECT * FROM r ORDER BY macro_f1 DESC, run LIMIT 1",
)
def best_validation_run(spark, sf):
    runs = _runs(spark, sf).withColumn("run", F.concat("model", "ablation", F.col("seed").cast("string")))
    return V.best_run(runs, "macro_f1", "run")


@query(
    "best_run_per_ablation",
    f"WITH {_RUNS_SQL} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ablation ORDER BY macro_f1 DESC, log_loss) AS rn FROM runs) WHERE rn = 1",
)
def best_run_per_ablation(spark, sf):
    return V.best_per_ablation(_runs(spark, sf))


@query(
    "run_summary",
    f"""WITH {_RUNS_SQL} SELECT model, ablation, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_pop(macro_f1), 6) AS macro_f1_std,
      round(avg(log_loss), 6) AS log_loss_mean, round(stddev_pop(log_loss), 6) AS log_loss_std FROM runs GROUP BY 1, 2""",
)
def run_summary(spark, sf):
    return rounded(V.summarize_runs(_runs(spark, sf), ["model", "ablation"], ["macro_f1", "log_loss"]))


@query(
    "completed_run_summary",
    f"""WITH {_RUNS_SQL}, c AS (SELECT model, CASE WHEN seed > 1996 THEN macro_f1 END AS macro_f1, CASE WHEN seed > 1998 THEN pr_auc END AS pr_auc FROM runs)
    SELECT model, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_pop(macro_f1), 6) AS macro_f1_std, round(avg(pr_auc), 6) AS pr_auc_mean,
      round(stddev_pop(pr_auc), 6) AS pr_auc_std FROM c WHERE macro_f1 IS NOT NULL OR pr_auc IS NOT NULL GROUP BY 1""",
)
def completed_run_summary(spark, sf):
    runs = _runs(spark, sf).select(
        "model", F.when(F.col("seed") > 1996, F.col("macro_f1")).alias("macro_f1"),
        F.when(F.col("seed") > 1998, F.col("pr_auc")).alias("pr_auc"),
    )
    return rounded(V.summarize_completed_runs(runs, ["model"], ["macro_f1", "pr_auc"]))


_MASK_SQL = f"""{_RUNS_SQL}, mr AS (SELECT ablation AS masked_group, 10 * seed + (CASE model WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END) AS seed, macro_f1, log_loss FROM runs),
 base AS (SELECT seed, macro_f1 AS b FROM mr WHERE masked_group = 'none')"""


def _mask_runs(spark, sf):
    place = F.lit(5)
    for i, name in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"), 1):
        place = F.when(F.col("model") == name, F.lit(i)).otherwise(place)
    return _runs(spark, sf).select(F.col("ablation").alias("masked_group"), (F.lit(10) * F.col("seed") + place).alias("seed"), "macro_f1", "log_loss")


@query(
    "mask_drops",
    f"WITH {_MASK_SQL} SELECT mr.*, round(b - macro_f1, 6) AS absolute_drop, round(CASE WHEN b <> 0 THEN (b - macro_f1) / b END, 6) AS relative_drop FROM mr LEFT JOIN base USING (seed)",
)
def mask_drops(spark, sf):
    return rounded(V.mask_drops(_mask_runs(spark, sf)))


@query(
    "mask_summary",
    f"""WITH {_MASK_SQL}, d AS (SELECT mr.*, b - macro_f1 AS a, CASE WHEN b <> 0 THEN (b - macro_f1) / b END AS r FROM mr LEFT JOIN base USING (seed))
    SELECT masked_group, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_pop(macro_f1), 6) AS macro_f1_std, round(avg(a), 6) AS absolute_drop, round(avg(r), 6) AS relative_drop
    FROM d GROUP BY 1""",
)
def mask_summary(spark, sf):
    return rounded(V.mask_summary(_mask_runs(spark, sf), ["macro_f1"]))


@query(
    "group_importance",
    f"""WITH {VISITS_SQL} SELECT segment AS feature_group, round(sum(spend) / 1000, 3) AS importance FROM visits GROUP BY 1""",
)
def group_importance(spark, sf):
    per_feature = visits(spark, sf).groupBy("segment", "priority").agg(F.sum("spend").alias("importance"))
    return rounded(
        V.group_importance(per_feature, "segment").select(
            F.col("segment").alias("feature_group"), (F.col("importance") / 1000).alias("importance")
        ), 3,
    )


@query("top_values", "SELECT o_orderkey AS row_id, o_totalprice AS spend FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_values(spark, sf):
    return V.top_k(bare_visits(spark, sf).select("row_id", "spend"), "spend", 20, "row_id")


@query(
    "bounded_sample",
    f"""SELECT o_custkey AS subject, CAST(o_orderdate AS DATE) AS visit_date, o_orderstatus AS state, o_orderkey AS row_id, o_totalprice AS spend
    FROM orders ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 300""",
)
def bounded_sample(spark, sf):
    return V.bounded_sample(bare_visits(spark, sf), "row_id", 300, seed=42)


@query(
    "metric_unpivot",
    f"""WITH {_RUNS_SQL} SELECT model, ablation, seed, 'macro_f1' AS metric, macro_f1 AS value FROM runs UNION ALL SELECT model, ablation, seed, 'log_loss', log_loss FROM runs""",
)
def metric_unpivot(spark, sf):
    return _runs(spark, sf).unpivot(["model", "ablation", "seed"], ["macro_f1", "log_loss"], "metric", "value")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "metric_pivot",
    f"""WITH {_RUNS_SQL} SELECT seed, ablation, {', '.join(f"""round(max(macro_f1) FILTER (WHERE model = '{m}'), 6) AS "{m}" """ for m in _SEGMENTS)}
    FROM runs GROUP BY 1, 2""",
)
def metric_pivot(spark, sf):
    return rounded(_runs(spark, sf).groupBy("seed", "ablation").pivot("model", list(_SEGMENTS)).agg(F.max("macro_f1")))


@query(
    "result_union",
    f"""WITH {PRED_SQL} SELECT split, 'a' AS part, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS mean_spend FROM pred GROUP BY 1
    UNION ALL SELECT split, 'b', CAST(count(*) AS BIGINT), round(avg(spend), 6) FROM pred GROUP BY 1""",
)
def result_union(spark, sf):
    rows = predictions(spark, sf)
    a = rows.groupBy("split").agg(F.count("*").alias("n")).withColumn("part", F.lit("a"))
    b = rows.groupBy("split").agg(F.count("*").alias("n"), F.avg("spend").alias("mean_spend")).withColumn("part", F.lit("b"))
    return rounded(a.unionByName(b, allowMissingColumns=True))


@query(
    "subject_intersection",
    "SELECT DISTINCT o_custkey AS subject FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000",
)
def subject_intersection(spark, sf):
    rows = bare_visits(spark, sf)
    return rows.where("state = 'F'").select("subject").intersect(rows.where("spend > 450000").select("subject"))


@query(
    "subject_semi_join",
    "SELECT o_orderkey AS row_id, o_custkey AS subject FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
)
def subject_semi_join(spark, sf):
    rows = bare_visits(spark, sf)
    return rows.join(rows.where("spend > 450000").select("subject"), "subject", "left_semi").select("row_id", "subject")
