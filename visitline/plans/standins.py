"""The shared tables read as visits, predictions and cohorts, in Spark and in SQL.

Subject = customer, visit = order, state = order status. ``4-NOT SPECIFIED`` priorities and
negative balances play the missing-value sentinel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from visitline.functions.states import StateScheme, encode_state

SCHEME = StateScheme(("F", "O", "P"))
FEATURES = ["spend", "balance", "priority", "segment"]
SPEC = dict(subject="subject", date="visit_date", label="state", row_id="row_id", scheme=SCHEME)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def visits(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left").select(
        F.col("o_custkey").alias("subject"),
        F.col("o_orderdate").cast("date").alias("visit_date"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("spend"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(" BL")).otherwise(F.lit("m06")).alias("visit_code"),
    )


def bare_visits(spark: SparkSession, sf: str) -> DataFrame:
    """Visits without subject covariates: no join is needed."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject"),
        F.col("o_orderdate").cast("date").alias("visit_date"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("spend"),
    )


VISITS_SQL = """visits AS (
  SELECT o_custkey AS subject, CAST(o_orderdate AS DATE) AS visit_date, o_orderstatus AS state, o_orderkey AS row_id,
         o_totalprice AS spend,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS priority,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, c_mktsegment AS segment,
         CASE WHEN o_orderpriority = '1-URGENT' THEN ' BL' ELSE 'm06' END AS visit_code,
         CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS code
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

PAIRS_SQL = f"""{VISITS_SQL},
gaps AS (
  SELECT a.*, b.visit_date AS future_date, b.row_id AS future_row, b.state AS future_state, b.code AS future_code,
         date_diff('day', a.visit_date, b.visit_date) AS days
  FROM visits a JOIN visits b ON a.subject = b.subject AND b.visit_date > a.visit_date),
pairs AS (SELECT *, days / 30.4375 AS months FROM gaps WHERE days / 30.4375 >= 6 AND days / 30.4375 <= 60)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three-class probabilities derived from order keys, truth = status, with many exact ties."""
    key = F.col("o_orderkey")
    w = [(key % m + 1).cast("double") for m in (7, 5, 3)]
    total = w[0] + w[1] + w[2]
    return table(spark, sf, "orders").select(
        key.alias("row_id"),
        F.col("o_custkey").alias("subject"),
        F.col("o_orderdate").cast("date").alias("visit_date"),
        encode_state(F.col("o_orderstatus"), SCHEME).alias("y"),
        F.col("o_orderstatus").alias("future_state"),
        F.array(*[x / total for x in w]).alias("prob"),
        F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), "validation")
        .otherwise("temporal_test")
        .alias("split"),
        F.col("o_totalprice").alias("spend"),
    )


PRED_SQL = """raw AS (
  SELECT o_orderkey AS row_id, o_custkey AS subject, CAST(o_orderdate AS DATE) AS visit_date,
         CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS y, o_orderstatus AS future_state,
         CAST(o_orderkey % 7 + 1 AS DOUBLE) AS w0, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS w1,
         CAST(o_orderkey % 3 + 1 AS DOUBLE) AS w2, o_totalprice AS spend,
         CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'validation' ELSE 'temporal_test' END AS split
  FROM orders),
shares AS (SELECT *, w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1, w2 / (w0 + w1 + w2) AS p2 FROM raw),
pred AS (SELECT *, greatest(p0, p1, p2) AS conf,
                CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS yhat FROM shares)"""


def binary_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Binary truth and a tied score per labelled document."""
    return table(spark, sf, "labels").select(
        "doc_id",
        F.col("quality").alias("y"),
        (((F.col("doc_id") * 7919) % 1000) / F.lit(1000.0)).alias("score"),
        F.col("toxic").alias("part"),
    )


BINARY_SQL = """scores AS (
  SELECT doc_id, quality AS y, ((doc_id * 7919) % 1000) / CAST(1000 AS DOUBLE) AS score, toxic AS part FROM labels)"""


def hash_sql(text: str, seed: int = 42) -> str:
    """The seeded order of splits, samples and draws in SQL."""
    return f"CAST('0x' || left(md5('{seed}:' || {text}), 15) AS BIGINT)"


PLACES_SQL = f"""places AS (
  SELECT subject, row_number() OVER (ORDER BY {hash_sql('subject')}, subject) - 1 AS position, count(*) OVER () AS n
  FROM (SELECT DISTINCT o_custkey AS subject FROM orders))"""
