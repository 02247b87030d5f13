"""The test tables as documents, sections, usage reports and nested conversations."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators import index
from siftline.operators.schema import Section
from siftline.sources.shared import shared_dir, size, stamp

SORTED_BYTES = 8 << 20
NOW_MS = 1_700_000_700_000
SECTIONS = [Section("*", 0, "body", "prefix", "plain"), Section("*", 1, "subject", "exact", "plain")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """namespace = source, schema = lang; every seventh document has a time to live."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.col("source").alias("namespace"), F.col("doc_id").cast("string").alias("uri"), F.col("lang").alias("schema"), (F.lit(1_700_000_000_000) + F.col("doc_id") * 1000).alias("creation_ts_ms"),
        F.when(F.col("doc_id") % 7 == 0, 500_000).otherwise(0).cast("long").alias("ttl_ms"), (F.col("n_chars") % 100).cast("int").alias("score"), F.lit(False).alias("deleted"),
        F.struct(F.array("text").alias("body"), F.array(F.left("text", F.lit(40))).alias("subject")).alias("props"),
    )


_built: dict[tuple, str] = {}


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """The folder of this table's written index: sections (tokens once), postings sorted by term, lengths. Built once a session and table."""
    key = (spark.sparkContext.applicationId, sf_dir, *stamp(spark, f"{sf_dir}/documents.parquet"))
    if key not in _built:
        at = f"{shared_dir(spark)}/siftline-index/{uuid.uuid4().hex}"
        atexit.register(_forget, spark, at)
        index.section_tokens(documents(spark, sf_dir), SECTIONS).write.parquet(f"{at}/sections")
        parts = spark.read.parquet(f"{at}/sections")
        # written first, as dealing out by range reads its input three times
        index.build_postings(parts).write.parquet(f"{at}/counted")
        posts = spark.read.parquet(f"{at}/counted")
        # a task sorts the postings of so many bytes of sections, whatever the size of the table
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size(spark, f"{at}/sections") // SORTED_BYTES))
        if not parts.groupBy("doc_id", "section_id").count().where("count > 1").isEmpty():
            posts = index.merge_repeated(posts)
        index.write_postings(posts, f"{at}/postings", n, marks=True)
        _forget(spark, f"{at}/counted")
        index.doc_lengths(documents(spark, sf_dir), parts).write.parquet(f"{at}/lengths")
        _built[key] = at
    return _built[key]


def _forget(spark: SparkSession, at: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        return


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_stored(spark, sf_dir)}/sections")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_stored(spark, sf_dir)}/postings")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_stored(spark, sf_dir)}/lengths")


def usage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id = user_id; view, click and purchase are the types 1 to 3."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3)
    micros = epoch_micros(F.col("ts"), e.schema["ts"].dataType)
    ms = F.expr("(us - pmod(us, 1000)) div 1000")
    return e.select(F.col("user_id").alias("doc_id"), kind.alias("usage_type"), micros.alias("us")).where("usage_type IS NOT NULL").select("doc_id", "usage_type", ms.alias("usage_timestamp_ms"))


def epoch_micros(c: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970, whatever the session's time zone: of the instant, or of a clock without zone taken as UTC."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c)
    # timestampdiff and casts to an instant would go by the session's zone
    seconds = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document a conversation: turns in order."""
    c = read(spark, sf_dir, "conversations")
    turn = F.struct("turn", F.array("role").alias("role"), F.array("text").alias("text"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    props = F.struct(F.col("t.role").getItem(0).alias("first"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.lit("Conversation").alias("schema"), props.alias("props"))
