"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

ROW_GROUP_BYTES = 16 << 20  # of a materialized file: the least that a task reads of it


def build_session(app_name: str = "visitline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; extra ``conf`` keys win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private one only where none is set on a local master.

    Elsewhere a missing setting is an error: a folder of the driver's machine is not seen by executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master}")
        folder = tempfile.mkdtemp(prefix="visitline-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "stage", row_group: int = ROW_GROUP_BYTES) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used before loops of model fits: the written table survives the loss of any executor, which
    a cached or locally checkpointed frame does not. Files have small row groups, so that what few tasks wrote
    is read by many; narrow tables that cost much per byte take smaller ones. The result carries its folder for ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", row_group).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._visitline_folder = path
    return written


def release(*frames: DataFrame) -> None:
    """Delete the folders of materialized frames that no later action will read."""
    for frame in frames:
        folder = getattr(frame, "_visitline_folder", None)
        if folder:
            jvm = frame.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per session."""
    if getattr(spark.sparkContext, "_visitline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="visitline-package-")) / "visitline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, str(source.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._visitline_shipped = True
