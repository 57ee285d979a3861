"""Queries: scans with sentinels, file counts and inventories, upserts, hashes and sinks.

Files are written from the shared tables into a fresh folder below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from visitline.functions import names as N
from visitline.plans.registry import query, rounded
from visitline.plans.standins import VISITS_SQL, table, visits
from visitline.session import shared_folder
from visitline.sources import inventory as V, sinks as K, tables as S


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _spelled_visits(spark, sf):
    """Visits as text with the four missing spellings and a padded header."""
    miss = F.lit("-4")
    return visits(spark, sf).select(
        F.col("row_id").cast("string").alias(" row_id "),
        F.col("subject").cast("string").alias("subject"),
        F.when(F.col("spend") > 400000, "-4.0").otherwise(F.col("spend").cast("string")).alias("spend"),
        F.coalesce(F.col("balance").cast("string"), miss).alias("balance"),
        F.coalesce("priority", F.lit(" ")).alias("priority"),
        F.when(F.col("segment") != "BUILDING", F.col("segment")).otherwise("bad, \"quoted\"\nvalue").alias("segment"),
    )


def _visits_csv(spark, sf) -> str:
    path = _folder(spark, "visits-csv")
    _spelled_visits(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return path


@query(
    "csv_scan",
    f"""WITH {VISITS_SQL} SELECT CAST(row_id AS VARCHAR) AS row_id, CAST(subject AS VARCHAR) AS subject,
      CASE WHEN segment <> 'BUILDING' THEN segment ELSE 'bad, "quoted"' || chr(10) || 'value' END AS segment FROM visits""",
)
def csv_scan(spark, sf):
    return S.read_csv(spark, _visits_csv(spark, sf)).select("row_id", "subject", "segment")


@query(
    "sentinel_scan",
    f"""WITH {VISITS_SQL} SELECT CAST(row_id AS VARCHAR) AS row_id, CASE WHEN spend > 400000 THEN NULL ELSE spend END AS spend, balance, priority FROM visits""",
)
def sentinel_scan(spark, sf):
    raw = S.read_csv(spark, _visits_csv(spark, sf))
    return S.pruned_scan(raw, ["row_id", "spend", "balance", "priority"], numeric=["spend", "balance"])


@query(
    "dictionary_scan",
    """SELECT trim(p_name) AS "FLDNAME", CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_brand END AS "TBLNAME", CASE WHEN p_type = 'SMALL' THEN '' ELSE p_type END AS "TEXT",
      CASE WHEN p_size < 10 THEN '' ELSE CAST(p_size AS VARCHAR) END AS "TYPE", '' AS "UNITS" FROM part""",
)
def dictionary_scan(spark, sf):
    part = table(spark, sf, "part")
    raw = part.select(
        F.concat(F.lit(" "), "p_name").alias("FLDNAME"),
        F.when(F.col("p_brand") == "Brand#1", "NaN").otherwise(F.col("p_brand")).alias("TBLNAME"),
        F.when(F.col("p_type") == "SMALL", "-4").otherwise(F.col("p_type")).alias("TEXT"),
        F.when(F.col("p_size") < 10, "None").otherwise(F.col("p_size").cast("string")).alias("TYPE"),
        F.lit(None).cast("string").alias("UNITS"),
    )
    return S.clean_dictionary(raw)


def _csv_tree(spark, sf) -> str:
    """One CSV folder per order priority, with line breaks inside quotes."""
    root = _folder(spark, "csv-tree")
    rows = visits(spark, sf).select(
        F.coalesce("priority", F.lit("none")).alias("part"), F.col("subject").alias("RID"), F.lit("bl").alias("VISCODE"),
        F.col("state").alias("DX"), F.col("spend").alias("MMSE"), F.col("balance").alias("ADAS11"), F.col("spend").alias("Hippocampus"),
        F.col("balance").alias("FDG"), F.concat("segment", F.lit("\nline")).alias("note"),
    )
    rows.repartition(4, "part").write.partitionBy("part").option("header", True).csv(root)
    return root


@query(
    "csv_record_counts",
    f"WITH {VISITS_SQL} SELECT coalesce(priority, 'none') AS part, CAST(count(*) AS BIGINT) AS rows FROM visits GROUP BY 1",
)
def csv_record_counts(spark, sf):
    counts = S.csv_record_counts(spark, _csv_tree(spark, sf))
    part = F.url_decode(F.regexp_extract(F.url_decode("file"), "part=([^/]+)/", 1))
    return counts.groupBy(part.alias("part")).agg(F.sum("rows").alias("rows"))


@query(
    "file_inventory",
    f"""WITH {VISITS_SQL} SELECT coalesce(priority, 'none') AS part, CAST(count(*) AS BIGINT) AS rows, CAST(8 AS INTEGER) AS columns, 'ok' AS read_status,
      'merged_adnimerge' AS primary_category, 'merged_adnimerge|diagnosis|cognitive|mri_measurement|pet_measurement' AS matched_categories, 'RID' AS id_columns FROM visits GROUP BY 1""",
)
def file_inventory(spark, sf):
    files = V.scan_folder(spark, _csv_tree(spark, sf))
    part = F.url_decode(F.regexp_extract(F.url_decode("file"), "part=([^/]+)/", 1))
    return files.select(
        part.alias("part"), "rows", "columns", "read_status", "primary_category",
        F.array_join("matched_categories", "|").alias("matched_categories"), F.array_join("id_columns", "|").alias("id_columns"),
    )


def _supplier_files(spark, sf) -> str:
    """A CSV file per 40 supplier keys with quoted line breaks; every fourth file is cut off inside a cell."""
    root = _folder(spark, "supplier-files")
    part = (F.col("s_suppkey") / 40).cast("bigint")
    rows = table(spark, sf, "supplier").withColumn("part", part)
    last = F.max("s_suppkey").over(Window.partitionBy("part")) == F.col("s_suppkey")
    note = (
        F.when(last & (F.col("part") % 4 == 1), '"cut').when(F.col("s_nationkey") % 3 == 0, "NA")
        .otherwise(F.concat(F.lit('"a,\n""'), "s_name", F.lit('"""')))
    )
    line = F.concat_ws(
        ",", "s_suppkey", F.lit("bl"), F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("s_acctbal").cast("string")),
        F.when(F.col("s_nationkey") % 5 == 0, "x").otherwise("1"), note,
    )
    heads = rows.select("part", F.lit(-1).cast("bigint").alias("o"), F.lit("RID,VISCODE,MMSE,mixed,note").alias("line")).distinct()
    lines = rows.select("part", F.col("s_suppkey").cast("bigint").alias("o"), line.alias("line")).unionByName(heads)
    (
        lines.repartition("part").sortWithinPartitions("part", "o").select("part", "line")
        .write.partitionBy("part").option("sep", "\u0001").option("quote", "\u0000").csv(root)
    )
    return root


@query(
    "file_missing_rates",
    """WITH s AS (SELECT *, CAST(s_suppkey // 40 AS BIGINT) AS part FROM supplier),
    f AS (SELECT part, CASE WHEN part % 4 = 1 THEN NULL ELSE CAST(count(*) AS BIGINT) END AS rows, CASE WHEN part % 4 = 1 THEN 'partial' ELSE 'ok' END AS read_status,
      concat_ws('|', CASE WHEN max(s_acctbal) >= 0 THEN 'MMSE' END, CASE WHEN avg((s_nationkey % 5 <> 0)::INT) >= 0.8 THEN 'mixed' END) AS measures,
      avg((s_acctbal < 0)::INT) AS no_mmse, avg((s_nationkey % 3 = 0 AND (part % 4 <> 1 OR s_suppkey <> last))::INT) AS no_note
      FROM (SELECT *, max(s_suppkey) OVER (PARTITION BY part) AS last FROM s) GROUP BY part),
    r AS (SELECT part, rows, read_status, measures, unnest(['RID', 'VISCODE', 'MMSE', 'mixed', 'note']) AS column_name,
      round(unnest([0, 0, no_mmse, 0, no_note]), 4) AS missing_rate FROM f)
    SELECT *, CAST(row_number() OVER (PARTITION BY part ORDER BY missing_rate DESC, column_name) AS INTEGER) AS place FROM r""",
)
def file_missing_rates(spark, sf):
    files = V.scan_folder(spark, _supplier_files(spark, sf)).select(
        F.regexp_extract("file", "part=([0-9]+)/", 1).cast("bigint").alias("part"), "rows", "read_status",
        F.array_join("measurement_columns", "|").alias("measures"), F.posexplode("missing_rate_top10").alias("place", "told"),
    )
    return files.select(
        "part", "rows", "read_status", "measures", (F.col("place") + 1).alias("place"),
        F.col("told.column").alias("column_name"), F.col("told.rate").alias("missing_rate"),
    )


@query(
    "file_group_availability",
    """SELECT key, available, CAST(CASE WHEN available THEN (SELECT count(DISTINCT o_orderpriority) FROM orders) ELSE 0 END AS INTEGER) AS n_files, matched_columns FROM (VALUES
      ('data_dictionary', false, ''), ('diagnosis', true, 'DX'), ('demographic', false, ''), ('apoe', false, ''), ('cognitive', true, 'MMSE|ADAS11'),
      ('mri_measurement', true, 'Hippocampus'), ('pet_measurement', true, 'FDG'), ('biofluid_csf', false, '')) t(key, available, matched_columns)""",
)
def file_group_availability(spark, sf):
    found = V.group_availability(V.scan_folder(spark, _csv_tree(spark, sf)))
    return found.select(
        "key", "available", F.size("files").alias("n_files"), F.array_join("matched_columns", "|").alias("matched_columns")
    )


# Tables described by a list of column names: one per supplier nation and part size.
_LISTS = {
    0: ["FLDNAME", "TBLNAME", "TEXT"], 1: ["RID", "VISCODE", "DX"], 2: ["AGE", "PTGENDER"], 3: ["APOE4"], 4: ["RID", "adas_q1"],
    5: ["RID", "Left-Hippocampus"], 6: ["SUMMARYSUVR", "RID"], 7: ["RID", "PTAU", "Abeta42"], 8: ["foo", "bar"],
}
_EXPECTED = {
    0: "data_dictionary", 1: "diagnosis", 2: "demographics", 3: "apoe", 4: "cognitive", 5: "mri_manifest_or_image_metadata",
    6: "pet_manifest_or_image_metadata", 7: "biofluid_csf", 8: "unknown",
}


@query(
    "table_classification",
    "SELECT s_suppkey, CASE s_suppkey % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _EXPECTED.items()) + " END AS primary_category FROM supplier",
)
def table_classification(spark, sf):
    kind = F.col("s_suppkey") % 9
    lists = F.create_map(*[x for k, v in _LISTS.items() for x in (F.lit(k).cast("bigint"), F.array(*[F.lit(c) for c in v]))])
    described = table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("t/"), F.col("s_suppkey").cast("string"), F.lit(".csv")).alias("file"),
        F.try_element_at(lists, kind).alias("columns"), F.array().cast("array<string>").alias("measurement_columns"),
    )
    return V.classify(described).select("s_suppkey", "primary_category")


@query(
    "name_matchers",
    r"""WITH c AS (SELECT p_partkey, [p_name, p_brand, p_type, upper(p_name)] AS cols FROM part)
    SELECT p_partkey, array_to_string([x FOR x IN cols IF regexp_replace(upper(x), '[^A-Z0-9]', '', 'g') IN ('SMALLRING', 'BRAND4', 'PROMO')], '|') AS equal_names,
      array_to_string([x FOR x IN cols IF upper(x) LIKE 'RED%' OR upper(x) LIKE 'BRAND#1%'][1:2], '|') AS prefixed,
      array_to_string([x FOR x IN cols IF regexp_matches(x, '(?i)^blue|mall$')], '|') AS matched, len([x FOR x IN cols IF contains(upper(x), 'WID')]) > 0 AS any_word FROM c""",
)
def name_matchers(spark, sf):
    cols = F.array("p_name", "p_brand", "p_type", F.upper("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(N.matching_names(cols, ["small ring", "Brand#4", "PROMO"]), "|").alias("equal_names"),
        F.array_join(N.prefixed_names(cols, ["RED", "BRAND#1"], 2), "|").alias("prefixed"),
        F.array_join(N.pattern_names(cols, ["^blue", "mall$"]), "|").alias("matched"),
        F.exists(cols, lambda c: N.contains_any(c, ["wid"])).alias("any_word"),
    )


@query(
    "numeric_measurements",
    """WITH t AS (SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS a, CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE '1' END AS b,
      CAST(o_totalprice AS VARCHAR) AS c FROM orders), s AS (SELECT 'mostly' AS column_name, avg((try_cast(a AS DOUBLE) IS NOT NULL)::INT) AS numeric_share FROM t
      UNION ALL SELECT 'partly', avg((try_cast(b AS DOUBLE) IS NOT NULL)::INT) FROM t UNION ALL SELECT 'price', avg((try_cast(c AS DOUBLE) IS NOT NULL)::INT) FROM t)
    SELECT column_name, round(numeric_share, 6) AS numeric_share FROM s WHERE numeric_share >= 0.79""",
)
def numeric_measurements(spark, sf):
    text = F.col("o_totalprice").cast("string")
    rows = table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "n/a").otherwise(text).alias("mostly"),
        F.when(F.col("o_orderstatus") == "F", "x").otherwise("1").alias("partly"),
        text.alias("price"),
        text.alias("QC_status"),
    )
    return rounded(V.numeric_measurements(rows, rows.columns, 0.79))


@query(
    "task_upsert",
    """SELECT o_orderstatus AS task_mode, o_orderkey, o_totalprice AS v, CAST(NULL AS VARCHAR) AS extra FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'F', o_orderkey, -1.0, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000""",
)
def task_upsert(spark, sf):
    orders = table(spark, sf, "orders")
    old = orders.select(F.col("o_orderstatus").alias("task_mode"), "o_orderkey", F.col("o_totalprice").alias("v"))
    new = orders.where("o_orderstatus = 'F' AND o_totalprice > 250000").select(
        F.lit("F").alias("task_mode"), "o_orderkey", F.lit(-1.0).alias("v"), F.col("o_orderpriority").alias("extra")
    )
    return K.replace_task_rows(old, new, "F")


@query(
    "partitioned_task_upsert",
    """SELECT o_orderstatus AS task_mode, CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE o_totalprice END), 2) AS total
    FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 250000 GROUP BY 1""",
)
def partitioned_task_upsert(spark, sf):
    path = _folder(spark, "tasks")
    orders = table(spark, sf, "orders")
    K.upsert_task(orders.select(F.col("o_orderstatus").alias("task_mode"), F.col("o_totalprice").alias("v")), path)
    K.upsert_task(
        orders.where("o_orderstatus = 'F' AND o_totalprice > 250000").select(F.lit("F").alias("task_mode"), F.lit(1.0).alias("v")), path
    )
    return rounded(K.read_tasks(spark, path).groupBy("task_mode").agg(F.count("*").alias("n"), F.sum("v").alias("total")), 2)


@query(
    "table_sinks",
    """SELECT f AS format, o_orderstatus AS state, CAST(count(*) AS BIGINT) AS n FROM orders, (VALUES ('csv'), ('json'), ('parquet')) t(f) GROUP BY 1, 2""",
)
def table_sinks(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("state"), F.array("o_orderkey").alias("keys"))
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = _folder(spark, f"sink-{fmt}")
        K.write_table(rows, path, fmt)
        schema = "state string, keys string" if fmt == "csv" else "state string, keys array<bigint>"
        read = spark.read.schema(schema).option("header", True).format(fmt).load(path)
        part = read.groupBy("state").agg(F.count("*").alias("n")).withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


@query("file_registry")
def file_registry(spark, sf):
    path = _visits_csv(spark, sf)
    registry = K.file_hashes(spark, path)
    return registry.join(K.changed_files(registry, K.file_hashes(spark, path)).select("path"), "path", "left_anti")


@query("nested_cells_as_json", "SELECT o_orderkey, '[' || o_orderkey || ',' || o_custkey || ']' AS keys FROM orders")
def nested_cells_as_json(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.array("o_orderkey", "o_custkey").alias("keys"))
    return K.flat_cells(rows)
