"""Written tables in the folder that driver and executors share: how lineage is cut; code for executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where the session names none (tests on one machine)
    is a temporary folder made and kept in the session's own settings."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("stageledger.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stageledger-")
        spark.conf.set("stageledger.shared.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/stageledger/{tag}-{uuid.uuid4().hex}"


#: Spark's own setting that removes an execution's shuffle files as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Cut the lineage with a written table in the shared folder.

    Nothing can read the write's shuffle files afterwards, so they go at once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stageledger_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` once nothing reads it."""
    path = getattr(df, "_stageledger_path", None)
    if path:
        jvm = df.sparkSession._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_stageledger_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="stageledger-code-")
    target = os.path.join(folder, "stageledger_code.zip")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    Path(target).write_bytes(buffer.getvalue())
    sc.addPyFile(target)
    sc._stageledger_shipped = True
