"""What the training-data operators share: shared storage, row keys, skew-safe joins."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or given to setCheckpointDir; a local one only in local mode, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = given.get() if given.isDefined() else None
        if not at and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = at or "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _drop_written() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            return


atexit.register(_drop_written)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/siftline/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # shuffle files go with the job that needed them
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, wherever their Python looks for modules."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="siftline-"), "siftline_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    ship(spark)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """The table's columns by their exact names, dots included."""
    return [F.col(f"`{c}`") for c in df.columns]


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ordered_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending quantile bounds of a long column; one narrow pass over that column."""
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    row = df.select(F.percentile_approx(F.col(key), F.array(*map(F.lit, at)), F.lit(20 * n)).alias("b")).first()
    return sorted({int(x) for x in (row["b"] or [])})


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the key: 0 for nulls. Binary search unrolled as nested conditions."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(key.isNull(), F.lit(0)).otherwise(search(0, len(bounds))) if bounds else F.lit(0)


def hot_keys(counts: DataFrame, key: str, n: str, total: int, share: float = 0.002, least: int = 2000) -> list:
    """Keys that hold more than `share` of all rows: fewer than 1 / share of them, whatever the data."""
    return [r[0] for r in counts.where(F.col(n) > F.lit(max(least, int(total * share)))).select(key).collect()]


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: list, spread: Column, salts: int = 64, how: str = "left") -> DataFrame:
    """Equi-join where `small` is unique on `key`: rows of hot keys are dealt over `salts` copies of the small side."""
    if not hot:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    left = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    right = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
