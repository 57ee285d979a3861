"""CSV and parquet scans that end in clean, pruned columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from visitline.operators.selection import require_columns
from visitline.sources.records import count_records, csv_lines, read_records, typed

# Cells that mean "missing" in data tables and in dictionary tables.
MISSING_CELLS = ("", " ", "-4", "-4.0")
DICTIONARY_EMPTY = ("", "-4", "-4.0", "nan", "none")
DICTIONARY_FIELDS = ("FLDNAME", "TBLNAME", "TEXT", "TYPE", "UNITS")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True, infer_types: bool = False
) -> DataFrame:
    """CSV with header; whitespace around column names is removed.

    ``multi_line`` respects line breaks inside quotes; files are split all the same (``sources.records``), at the
    price of writing their lines once. Without it Spark's own reader takes every line for a record.
    ``infer_types`` reads the data once more to find numeric and time columns; all columns are text otherwise,
    or as in ``schema``.
    """
    if multi_line:
        df = read_records(spark, path, schema)
        folder = getattr(df, "_visitline_folder", None)
        df = typed(df) if infer_types and schema is None and df.columns else df
    else:
        folder = None
        reader = spark.read.option("header", True).option("escape", '"').option("inferSchema", infer_types)
        try:
            df = (reader.schema(schema) if schema is not None else reader).csv(path)
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"Data file not found: {path}") from exc
            raise
    named = df.toDF(*[c.strip() for c in df.columns])
    if folder:
        named._visitline_folder = folder
    return named


def null_missing(df: DataFrame, cells: Sequence[str] = MISSING_CELLS) -> DataFrame:
    """Sentinel texts, sentinel numbers and NaN become null, once, at the source."""
    numbers = sorted({float(c) for c in cells if c.strip().lstrip("-").replace(".", "").isdigit()})

    def clean(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            return F.when(~c.isin(*cells), c).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~(c.isin(*numbers) | F.isnan(c)), c).alias(field.name)
        if isinstance(field.dataType, T.NumericType):
            return F.when(~c.isin(*numbers), c).alias(field.name)
        return c

    return df.select(*[clean(f) for f in df.schema.fields])


def pruned_scan(
    df: DataFrame, required: Sequence[str], numeric: Sequence[str] = (), cells: Sequence[str] = MISSING_CELLS
) -> DataFrame:
    """Only the required columns, sentinels as null, ``numeric`` columns cast where they can be.

    Absent columns are listed in the error before any data is read.
    """
    wanted = list(dict.fromkeys(required))
    require_columns(df, wanted)
    clean = null_missing(df.select(*[F.col(f"`{c}`") for c in wanted]), cells)
    return clean.withColumns({c: F.col(c).try_cast("double") for c in numeric})


def longitudinal_scan(
    df: DataFrame, features: Sequence[str], subject: str, date: str, label: str, numeric: Sequence[str] = ()
) -> DataFrame:
    return pruned_scan(df, [subject, date, label, *features], numeric)


def clean_dictionary(df: DataFrame) -> DataFrame:
    """All cells as trimmed text, with the empty spellings turned into ``""``."""
    require_columns(df, DICTIONARY_FIELDS)

    def clean(name: str) -> Column:
        text = F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
        return F.when(F.lower(text).isin(*DICTIONARY_EMPTY), "").otherwise(text).alias(name)

    return df.select(*[clean(c) for c in df.columns])


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return clean_dictionary(read_csv(spark, path))


def csv_record_counts(spark: SparkSession, path: str) -> DataFrame:
    """Records per CSV file without the header; line breaks inside quotes do not count, and large files are split.

    ``closed`` is false where a file ends inside a quoted cell, as one that was cut off does: its ``rows`` is null.
    A file that can't be read fails the job. An empty file has no row.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]")
    counts = count_records(csv_lines(reader, path))
    return counts.select("file", F.when(F.col("closed"), F.col("rows")).alias("rows"), "closed")
