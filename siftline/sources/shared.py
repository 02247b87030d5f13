"""Where the engine keeps tables that outlive a query."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or what setCheckpointDir was given; a temporary folder only where driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = given.get() if given.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stamp(spark: SparkSession, path: str) -> tuple:
    """Length and time of change of a file or folder: another stamp, another table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    return s.getLen(), s.getModificationTime()


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
