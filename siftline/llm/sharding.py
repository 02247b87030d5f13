"""Sharding by sampled splitters, under the law `bytes`.

Records are ordered by (hash of the text, doc_id, row), so equal texts stand together and a group
larger than a shard is still divisible. Size-weighted keys are drawn by hash (each with probability
size x rate), their quantiles become range bounds, ranges that turn out overfull get bounds from a
denser draw of their own, and exact running sums over the ranges place shard boundaries.

Defined results: null text has size 1 and no text; null doc_id sorts first; repeated rows get slots
of their own; an empty table gives no row; extra columns are ignored. Near equality is bounded by the largest
records only: shards differ by less than the size of two.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, partitions

KEY = ("_h", "_d", "_r")


def _draw(keys: DataFrame, rate: float, seed: int) -> list[tuple]:
    """Keys drawn with probability size x rate (a record at most once); their number follows the rate, not the data."""
    u = (F.xxhash64("_d", "_r", F.lit(seed)) / F.lit(2.0**64) + F.lit(0.5))
    got = keys.where(u < F.col("size") * F.lit(rate)).select(*KEY, "size").collect()
    return sorted((r["_h"], r["_d"], r["_r"], r["size"]) for r in got)


def _quantiles(draw: list[tuple], n: int) -> list[tuple]:
    return sorted({draw[len(draw) * i // n][:3] for i in range(1, n)}) if draw else []


def _ranges(keys: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Range number by binary search over the bounds (some a range, kept as the task's closure); only rows whose hash is a bound's compare more than that."""
    first = np.array([b[0] for b in bounds], np.int64)

    @F.pandas_udf(T.IntegerType())
    def find(h: pd.Series, d: pd.Series, r: pd.Series) -> pd.Series:
        lo, out = np.searchsorted(first, h.to_numpy(), "left"), np.searchsorted(first, h.to_numpy(), "right")
        for i in np.flatnonzero(lo < out).tolist():
            out[i] = bisect.bisect_right(bounds, (int(h.iloc[i]), int(d.iloc[i]), int(r.iloc[i])))
        return pd.Series(out.astype("int32"))

    return keys.withColumn("_range", find(*KEY))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64(raw).alias("_h"), F.monotonically_increasing_id().alias("_r"),
    )
    # the row number is drawn once and written, so a lost executor cannot change it
    keys = materialize(slim.withColumn("_d", F.coalesce("doc_id", F.lit(-(2**63)))), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    n = ranges or max(4 * shards, 2 * partitions(spark))
    bounds = _quantiles(_draw(keys, 32 * n / max(total, 1), seed), n)
    for deeper in range(1, 33):  # subdivide what is overfull, by draws that grow until it is not
        stats = {r[0]: (r[1], r[2]) for r in _ranges(keys, bounds).groupBy("_range").agg(F.sum("size"), F.count("*")).collect()}
        over = [k for k, (size, rows) in stats.items() if size > 2 * total / n and rows > 1]
        if not over:
            break
        held = _ranges(keys, bounds).where(F.col("_range").isin(over)).drop("_range")
        extra = _draw(held, 64 * n * 4**deeper / max(total, 1), seed + deeper)
        for k in over:
            lo, hi = (bounds[k - 1] if k else None), (bounds[k] if k < len(bounds) else None)
            mine = [x for x in extra if (lo is None or x[:3] >= lo) and (hi is None or x[:3] < hi)]
            bounds = bounds + _quantiles(mine, 1 + int(stats[k][0] * n / total))
        bounds = sorted(set(bounds))
    else:
        raise RuntimeError(f"{len(over)} ranges stay overfull")
    # one row a range: exact running totals place every record
    before, b_size, b_rows = [], 0, 0
    sums = {r[0]: (r[1], r[2]) for r in _ranges(keys, bounds).groupBy("_range").agg(F.sum("size"), F.count("*")).collect()}
    for k in range(len(bounds) + 1):
        before.append((k, b_size, b_rows))
        b_size, b_rows = b_size + sums.get(k, (0, 0))[0], b_rows + sums.get(k, (0, 0))[1]
    offsets = F.broadcast(spark.createDataFrame(before, "_range int, _size0 long, _row0 long"))
    ordered = Window.partitionBy("_range").orderBy(*KEY)
    upto = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    laid = _ranges(keys, bounds).repartitionById(len(bounds) + 1, F.col("_range")).withColumn("_upto", upto).withColumn("_row", F.row_number().over(ordered)).join(offsets, "_range")
    middle = F.col("_size0") + F.col("_upto") - F.col("size") / 2
    laid = laid.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1)))).cast("int"))).withColumn("_at", F.col("_row0") + F.col("_row") - 1)
    laid = materialize(laid.select("doc_id", "size", "text_crc32", "shard", "_at"), "shard-rows")
    first = F.broadcast(laid.groupBy("shard").agg(F.min("_at").alias("_first")))  # one row a shard
    return laid.join(first, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
