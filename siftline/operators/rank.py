"""Order, limits by group, pages and cursors."""

from __future__ import annotations

import random
from collections import OrderedDict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUM_TO_SCORE = 30_000
CACHED_HITS = 299_593
PAGE = 10


def keys(order: str = "desc"):
    return (F.col("score").desc(), F.col("doc_id").desc()) if order == "desc" else (F.col("score").asc(), F.col("doc_id").asc())


def cap_scored(matched: DataFrame, n: int = NUM_TO_SCORE) -> DataFrame:
    """Only the newest n documents are scored: a top-k, taken partly in each task."""
    return matched.orderBy(F.col("doc_id").desc()).limit(n)


def group_limit(scored: DataFrame, groups: list[tuple[list[str], int]], order: str = "desc") -> DataFrame:
    """At most max_results of each group of namespaces over the whole query; other namespaces are not limited."""
    if not groups:
        return scored
    names = [x for ns, _ in groups for x in ns]
    if len(names) != len(set(names)) or any(m <= 0 for _, m in groups):
        raise ValueError("namespaces must be unique across groups and max_results positive")
    g, most = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (ns, m) in enumerate(groups):
        g = F.when(F.col("namespace").isin(ns), i).otherwise(g)
        most = F.when(F.col("namespace").isin(ns), m).otherwise(most)
    rows = scored.withColumn("_g", g).withColumn("_most", most)
    free = rows.where("_g IS NULL")
    # a constant bound lets each task keep its own best before the shuffle
    top = max(m for _, m in groups)
    held = rows.where("_g IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(*keys(order)))).where(F.col("_n") <= top).where(F.col("_n") <= F.col("_most")).drop("_n")
    return free.unionByName(held).drop("_g", "_most")


def page(scored: DataFrame, number: int = 0, per_page: int = PAGE, order: str = "desc", truncate: int = CACHED_HITS) -> DataFrame:
    """Rows of one page with their rank, from 1. Two top-k steps; nothing else is sorted."""
    if per_page < 0:
        raise ValueError("num_per_page must not be negative")
    top = scored.orderBy(*keys(order)).limit(min(truncate, (number + 1) * per_page))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*keys(order))))
    return ranked.where((F.col("rank") > number * per_page) & (F.col("rank") <= (number + 1) * per_page))


class Cursors:
    """Next-page tokens; the oldest go when the total of cached hits exceeds the budget."""

    def __init__(self, budget: int = CACHED_HITS, seed: int | None = None):
        self.budget, self.held, self.rng = budget, OrderedDict(), random.Random(seed)

    def add(self, ranked: DataFrame, total: int, per_page: int) -> int:
        """A token for the pages after the first, or 0 if there are none."""
        if per_page <= 0 or total <= per_page:
            return 0
        token = 0
        while token == 0 or token in self.held:
            token = self.rng.getrandbits(64)
        self.held[token] = [ranked, total, per_page, per_page]
        while sum(x[1] for x in self.held.values()) > self.budget and len(self.held) > 1:
            self.drop(next(iter(self.held)))
        return token

    def next(self, token: int) -> tuple[DataFrame | None, int]:
        """(rows, token to go on with); an unknown token gives nothing."""
        if token not in self.held:
            return None, 0
        ranked, total, at, step = self.held[token]
        rows = ranked.where((F.col("rank") > at) & (F.col("rank") <= at + step))
        if at + step >= total:
            self.held.pop(token)
            return rows, 0
        self.held[token][2] = at + step
        return rows, token

    def drop(self, token: int) -> None:
        x = self.held.pop(token, None)
        if x:
            x[0].unpersist()

    def clear(self) -> None:
        for t in list(self.held):
            self.drop(t)
