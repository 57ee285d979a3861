"""Writing result tables, replacing one task's rows, model folders and file hashes."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def flat_cells(df: DataFrame) -> DataFrame:
    """Nested cells as JSON text, so that a table fits a CSV file."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Result table as parquet, csv (header, nested cells as JSON) or json."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"Unsupported table format: {fmt}")
    out = flat_cells(df) if fmt == "csv" else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def replace_task_rows(old: DataFrame, new: DataFrame, task: str, key: str = "task_mode") -> DataFrame:
    """``old`` without the rows of ``task``, followed by ``new``; columns are united."""
    kept = old.where(~F.col(key).eqNullSafe(F.lit(task))) if key in old.columns else old
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_task(df: DataFrame, path: str, key: str = "task_mode") -> None:
    """Overwrite only the partitions of the tasks in ``df``; other tasks' files are untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of every file below ``path``; each file is hashed in its own task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def changed_files(registry: DataFrame, current: DataFrame) -> DataFrame:
    """Registered files that are gone or hash differently now."""
    now = current.select("path", F.col("sha256").alias("now"))
    return registry.join(now, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("now")))


def assert_unchanged(registry: DataFrame, current: DataFrame) -> None:
    changed = changed_files(registry, current)
    n = changed.count()
    if n:
        first = changed.orderBy("path").select("path").limit(20).collect()
        raise RuntimeError(f"{n} frozen files changed, the first: " + ", ".join(r["path"] for r in first))
