"""A durable hand-over between jobs: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs on one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="verisieve-")
        if spark.conf.isModifiable("spark.checkpoint.dir"):
            spark.conf.set("spark.checkpoint.dir", where)
        else:
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    The lineage ends there, so a lost executor costs the tasks it ran and not the whole chain, and the reread table has true size
    statistics, by which Spark chooses (and bounds) broadcasts.
    """
    path = f"{shared_dir(df.sparkSession)}/verisieve/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._verisieve_path = path  # for discard()
    return back


def discard(df: DataFrame) -> None:
    """Removes a table that ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_verisieve_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
