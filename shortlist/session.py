"""Session for tests and benches, and the helpers that touch its settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SENT_BYTES = 32 << 20


def local_session(cpus: int | str = "*", app: str = "shortlist") -> SparkSession:
    """A local session; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach; a temporary one only in local mode, if none is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shortlist-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed."""
    return df.limit(rows + 1).agg(F.count(F.lit(1))).first()[0] <= rows


def sent_if_few(df: DataFrame, rows: int, size: int = MAX_SENT_BYTES) -> DataFrame:
    """Broadcast a table if it is measured to have at most ``rows`` rows and ``size`` bytes.

    A larger one is not broadcast, whatever Spark's estimate of its size is.
    """

    def width(name: str, kind: str):
        if kind == "string":
            return F.coalesce(F.octet_length(name), F.lit(0))
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) if "<" in kind else F.lit(16)

    total = sum((width(*column) for column in df.dtypes), F.lit(0)).cast("long")
    n, used = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and used <= size else df.hint("merge")
