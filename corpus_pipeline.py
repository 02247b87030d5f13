"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. run() writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import mixing, near_copies, packing, pii, toxicity
from siftline.llm.common import free_name, materialize, own_columns, ship, table, text_or_empty

#: Shares of tokens by quality; covering them repeats documents and drops none.
MIX = {"low": 0.15, "high": 0.85}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects (score 0.5 or more)."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.with_scores(docs, model, name=score).where(F.col(score) < 0.5).select(*own_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): that of the smallest doc_id.

    Rows are told apart by a written key, so no row stands for another because they share a doc_id or have none.
    Rows without doc_id come after all others; ties go by hash of text, then of the other columns.
    """
    ship(spark)
    row = free_name(docs, "row")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    other = F.xxhash64(*rest) if rest else F.lit(0).cast("long")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.sha2(text_or_empty().cast("binary"), 256).alias("hash"), other.alias("other"), F.col(row).alias("row"))
    classes = rows.select(order.alias("o")).groupBy("o.hash").agg(F.min("o").alias("o"))
    classes = materialize(classes.select("o", F.col("o.row").alias("node")), "classes")
    # the same plan at every size: lists of keys grow with the input and are never broadcast
    first = rows.select(F.col(row).alias("node"), text_or_empty().alias("text")).join(classes.select("node").hint("merge"), "node", "left_semi")
    alike = near_copies.groups(materialize(first, "distinct-texts"))
    rooted = classes.join(alike.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = materialize(rooted.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.row").alias(row)), "kept")
    return rows.join(kept.hint("merge"), row, "left_semi").select(*own_columns(docs))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix wants them."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"), MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("pii", redact_personal), ("mixing", mix_sources), ("packing", pack_sequences)]
#: Trained models, components and linear programs are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
