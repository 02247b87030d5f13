"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialize, salted_join


def _with_min(edges: DataFrame, self_too: bool, total: int) -> DataFrame:
    mins = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if self_too:
        mins = mins.withColumn("m", F.least("m", "u"))
    hot = hot_keys(mins, "u", "n", total)
    return salted_join(edges, mins.drop("n"), "u", hot, F.col("v"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node reachable.

    `edges`: (u, v) longs. Each round is written to the shared folder. A hub's links are dealt over
    several tasks. No links give no rows; loops and repeats change nothing.
    """
    now = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if not state["n"] or (state["n"], state["x"]) == mark:
            break
        mark = (state["n"], state["x"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both, True, 2 * state["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        near = _with_min(small, False, state["n"])
        star = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        now = materialize(star.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    # settled: every link is (root, node)
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
