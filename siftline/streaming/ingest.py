"""Continuous ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.engine import SearchEngine
from siftline.operators.store import TYPES


def put_stream(stream: DataFrame, engine: SearchEngine, checkpoint: str):
    """Upsert each micro-batch by (namespace, uri), last write wins; persists after each, so a restart goes on from the checkpoint.

    A batch is indexed as a delta by the next search; what the session holds beside documents is not reloaded.
    """

    def each(batch: DataFrame, _: int) -> None:
        engine.put(batch)
        if engine.path:
            engine.persist(full=False)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_stream(stream: DataFrame) -> DataFrame:
    """Counts and last-used seconds per document. Both commute, so late reports need no watermark; use output mode update or complete."""
    out = []
    for t in TYPES:
        own = F.col("usage_type") == t
        out += [F.count_if(own).alias(f"cnt{t}"), F.coalesce(F.max(F.when(own, F.floor(F.col("usage_timestamp_ms") / 1000))), F.lit(0)).alias(f"last{t}_s")]
    return stream.groupBy("namespace", "uri").agg(*out)
