"""Document table operations: upsert, deletes, expiry, usage, compaction, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.sources.shared import shared_dir

INT_MAX, UINT_MAX = 2**31 - 1, 2**32 - 1
TYPES = (1, 2, 3)
ZERO_USAGE = {f"cnt{t}": 0 for t in TYPES} | {f"last{t}_s": 0 for t in TYPES}


def expired(now_ms: int) -> Column:
    """Whether creation + ttl has come; a ttl of 0, or a sum past the range of a long, never comes."""
    end = F.try_add(F.col("creation_ts_ms"), F.col("ttl_ms"))
    return (F.col("ttl_ms") != 0) & F.coalesce(F.lit(now_ms) >= end, F.lit(False))


def alive(docs: DataFrame, now_ms: int) -> DataFrame:
    rows = docs.where(~F.col("deleted")) if "deleted" in docs.columns else docs
    return rows.where(~expired(now_ms))


def doc_filter(docs: DataFrame, now_ms: int, namespaces: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    rows = alive(docs, now_ms)
    if namespaces:
        rows = rows.where(F.col("namespace").isin(namespaces))
    return rows.where(F.col("schema").isin(types)) if types else rows


def number(batch: DataFrame, first: int, order: str) -> DataFrame:
    """Dense doc_ids in `order` from `first`, without one task that sees all rows: counts by range, then offsets. Rows are written before they are counted."""
    spark = batch.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = batch.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id()).withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    laid = write_once(laid)
    sizes = laid.groupBy("_p").count()
    before = sizes.withColumn("_o", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    return laid.join(F.broadcast(before), "_p").withColumn("doc_id", F.lit(first) + F.col("_o") + F.col("_n") - 1).drop("_p", "_n", "_o")


def write_once(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: a plan of one scan, the same rows however often it runs."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/siftline-tables/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def latest(log: DataFrame) -> DataFrame:
    """The last generation of each (namespace, uri)."""
    w = Window.partitionBy("namespace", "uri").orderBy(F.col("doc_id").desc())
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(docs: DataFrame, batch: DataFrame, now_ms: int) -> DataFrame:
    """Rows of the batch (with doc_ids) join the table; the older generation of a key that is not expired is marked deleted."""
    batch = batch.withColumn("creation_ts_ms", F.when(F.coalesce("creation_ts_ms", F.lit(0)) == 0, F.lit(now_ms)).otherwise(F.col("creation_ts_ms"))).withColumn("deleted", F.lit(False))
    both = docs.unionByName(batch)
    newest = F.max("doc_id").over(Window.partitionBy("namespace", "uri"))
    old = F.col("doc_id") < newest
    return both.withColumn("deleted", F.col("deleted") | (old & ~expired(now_ms)))


def delete_keys(docs: DataFrame, gone: DataFrame, now_ms: int) -> DataFrame:
    """Mark alive rows whose (namespace, uri) is in `gone`."""
    hit = docs.join(gone.select("namespace", "uri", F.lit(True).alias("_gone")).distinct(), ["namespace", "uri"], "left")
    return hit.withColumn("deleted", F.col("deleted") | (F.coalesce("_gone", F.lit(False)) & ~expired(now_ms))).drop("_gone")


def delete_where(docs: DataFrame, condition: Column, now_ms: int) -> DataFrame:
    return docs.withColumn("deleted", F.col("deleted") | (condition & ~expired(now_ms)))


def delete_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    hit = docs.join(ids.select("doc_id", F.lit(True).alias("_gone")), "doc_id", "left")
    return hit.withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def usage_scores(reports: DataFrame, keys: list[str], latest_s: int | None = UINT_MAX) -> DataFrame:
    """Counts (saturating) and last-used seconds by type (saturating at latest_s, if given); order of arrival does not matter."""
    out = []
    for t in TYPES:
        own = F.col("usage_type") == t
        out.append(F.least(F.count_if(own), F.lit(INT_MAX)).alias(f"cnt{t}"))
        seconds = F.floor(F.col("usage_timestamp_ms") / 1000).cast("long")
        last = F.coalesce(F.max(F.when(own, seconds)), F.lit(0).cast("long"))
        out.append((last if latest_s is None else F.least(last, F.lit(latest_s))).alias(f"last{t}_s"))
    return reports.groupBy(*keys).agg(*out)


def carry_usage(log: DataFrame, reports: DataFrame, latest_s: int | None = UINT_MAX) -> DataFrame:
    """Usage of each generation: a re-put clones what its key had, unless the key was deleted first.

    `log` has doc_id, namespace, uri, put_ms and fresh (true if the key was deleted before this put).
    """
    start = F.sum(F.col("fresh").cast("int")).over(Window.partitionBy("namespace", "uri").orderBy(F.col("doc_id").asc_nulls_last()))
    eras = log.withColumn("_era", F.coalesce(start, F.lit(0)))
    first = eras.groupBy("namespace", "uri", "_era").agg(F.min("put_ms").alias("_from"))
    bounds = first.withColumn("_to", F.lead("_from").over(Window.partitionBy("namespace", "uri").orderBy("_era")))
    mine = reports.join(bounds, ["namespace", "uri"]).where((F.col("reported_ms") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("reported_ms") < F.col("_to"))))
    scores = usage_scores(mine, ["namespace", "uri", "_era"], latest_s)
    return eras.join(scores, ["namespace", "uri", "_era"], "left").na.fill(ZERO_USAGE).drop("_era")


def optimize(docs: DataFrame, now_ms: int) -> DataFrame:
    """Alive documents with dense ids from 0 in the old order."""
    return number(alive(docs, now_ms).withColumnRenamed("doc_id", "old_doc_id"), 0, "old_doc_id")


def optimize_info(docs: DataFrame, now_ms: int, size_bytes: int, last_ms: int = 0) -> DataFrame:
    dead = F.col("deleted") | expired(now_ms)
    out = docs.agg(F.count_if(dead).alias("optimizable_docs"), F.count("*").alias("total_docs"))
    est = F.coalesce(F.try_divide(F.lit(size_bytes) * F.col("optimizable_docs"), F.col("total_docs")), F.lit(0.0)).cast("long")
    return out.withColumn("estimated_optimizable_bytes", est).withColumn("time_since_last_optimize_ms", F.lit(now_ms - last_ms))


def storage_info(docs: DataFrame, now_ms: int, usage: DataFrame | None = None) -> DataFrame:
    """Alive, expired and deleted counts by namespace (and, with usage, how many of each hold a score of each type)."""
    ex = ~F.col("deleted") & expired(now_ms)
    ok = ~F.col("deleted") & ~expired(now_ms)
    rows = docs if usage is None else docs.join(usage, "doc_id", "left").na.fill(ZERO_USAGE)
    extra = [] if usage is None else [F.count_if(c & (F.col(f"cnt{t}") > 0)).alias(f"{n}_type{t}") for t in TYPES for n, c in (("alive", ok), ("expired", ex))]
    return rows.groupBy("namespace").agg(F.count_if(ok).alias("alive"), F.count_if(ex).alias("expired"), F.count_if(F.col("deleted")).alias("deleted"), *extra)


def namespaces(docs: DataFrame, now_ms: int) -> DataFrame:
    return alive(docs, now_ms).select("namespace").distinct()
