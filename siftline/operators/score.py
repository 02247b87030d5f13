"""Scorers, each a Column over matched documents; BM25F adds two small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.plans.match import active
from siftline.plans.query import leaves

K1, B = 1.2, 0.7
DEFAULT = {"desc": 0.0, "asc": 1.7976931348623157e308}


def idf(n_docs: Column, nq: Column) -> Column:
    return F.when(nq != 0, F.log(1 + (n_docs - nq + 0.5) / (nq - 0.5))).otherwise(0.0)


def normalized_tf(f: Column, dl: Column, avgdl: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def bm25f(matched: DataFrame, hits: DataFrame, corpus_docs: DataFrame, lengths: DataFrame, stats: DataFrame, node) -> DataFrame:
    """matched with `score`. n(q) counts the filtered documents that hold the term in any section."""
    ls = leaves(node)
    if not ls:
        return matched.withColumn("score", F.lit(0.0))
    texts = list(dict.fromkeys(t.text for t in ls))
    counts = hits.join(corpus_docs.select("doc_id", "namespace", "schema"), "doc_id").groupBy("namespace", "schema")
    counts = counts.agg(*[F.count_if(F.col(f"a{i}")).alias(f"n{i}") for i in range(len(texts))])
    rows = matched.join(lengths.select("doc_id", "dl"), "doc_id").join(stats.select("namespace", "schema", "n_docs", "avgdl"), ["namespace", "schema"]).join(counts, ["namespace", "schema"], "left")
    marks = {t: F.coalesce(F.col(f"f{i}") > 0, F.lit(False)) for i, t in enumerate(ls)}
    uses = active(node, marks)
    score = F.lit(0.0)
    for i, text in enumerate(texts):
        f = F.lit(0)
        for t, on in reversed([u for u in uses if u[0].text == text]):
            f = F.when(on, F.coalesce(F.col(f"f{ls.index(t)}"), F.lit(0))).otherwise(f)
        n = F.coalesce(F.col(f"n{i}"), F.lit(0))
        score = score + F.when(f > 0, idf(F.col("n_docs"), n) * normalized_tf(f, F.col("dl"), F.col("avgdl"))).otherwise(0.0)
    return rows.withColumn("score", score).drop("dl", "n_docs", "avgdl", *[f"n{i}" for i in range(len(texts))])


def simple(rank_by: str, order: str) -> Column:
    """Scores that need no text; usage columns come from a left join."""
    default = F.lit(DEFAULT[order])
    if rank_by == "none":
        return default
    if rank_by == "document_score":
        return F.coalesce(F.col("score_input").cast("double"), default)
    if rank_by == "creation_timestamp":
        return F.coalesce(F.col("creation_ts_ms").cast("double"), default)
    kind, what = rank_by.removeprefix("usage_type").split("_", 1)
    if what == "count":
        return F.coalesce(F.col(f"cnt{kind}").cast("double"), F.lit(0.0))
    if what == "last_used":
        return F.coalesce(F.col(f"last{kind}_s") * 1000.0, F.lit(0.0))
    raise ValueError(f"unknown ranking: {rank_by}")
