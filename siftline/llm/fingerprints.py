"""SimHash document fingerprints and their search by permuted block tables.

Terms are the five-word shingles of the lower-cased text; a term that occurs f times votes with
weight 1 + ln f, plus on the bits its hash sets and minus on the others. A bit of the fingerprint is
1 if its votes are positive. Equal texts have equal fingerprints.

The search finds all fingerprints within `radius` bits of given ones: the 64 bits are cut into blocks, and whichever
bits differ, some blocks agree, so each choice of that many blocks is a table whose key is exact.
Equal fingerprints are one row of a table; fingerprints under a hot key are dealt over several tasks, which all get the key's
queries. In `edit_digest` the queries are the documents whose doc_id is divisible by `every`, held against all documents.

Defined results: null text is the empty text, whose fingerprint is zero; texts of under five words are
one term; texts of any length are read whole; null doc_id sorts first; repeated rows follow each other
(ties go by text); the only row of a table is its own next; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, hot_keys, materialize, ordered_bounds, partitions, salted_join, text_or_empty
from .shingles import bit_sums, pack_bits, shingle_hashes, signed

WORDS = 5


def fingerprint(text: str | None, k: int = WORDS) -> int:
    h = shingle_hashes((text or "").lower().encode("utf-8", "replace").split(), k)
    if not len(h):
        return 0
    terms, f = np.unique(h, return_counts=True)
    if len(terms) == len(h):
        return pack_bits(2 * bit_sums(terms) > len(terms))
    w = 1 + np.log(f)
    return pack_bits(2 * bit_sums(terms, w) > w.sum())


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / 64


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [signed(fingerprint(t, k)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _keyed(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """fp, key: the rows of all tables; a table's number is part of its keys."""
    width = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << width[i + 1]) - 1) ^ ((1 << width[i]) - 1) for i in range(blocks)]
    masks = [signed(sum(part[i] for i in keep)) for keep in combinations(range(blocks), blocks - radius)]
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("key"))


def near_fingerprints(fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6, parts: int = 16) -> DataFrame:
    """(query, fp, distance): every distinct fingerprint within `radius` bits of each distinct query, itself included. Both: fp."""
    tables = _keyed(fps.select("fp").where("fp IS NOT NULL").distinct(), radius, blocks)
    asked = _keyed(queries.select("fp").where("fp IS NOT NULL").distinct(), radius, blocks).withColumnRenamed("fp", "query")
    counts = tables.groupBy("key").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "key", "n", fps.count())
    mine = F.when(F.col("key").isin(hot), F.pmod(F.xxhash64("fp"), F.lit(parts))).otherwise(F.lit(0)) if hot else F.lit(0)
    all_parts = F.explode(F.when(F.col("key").isin(hot), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))) if hot else F.lit(0)
    met = tables.withColumn("part", mine.cast("int")).hint("shuffle_hash").join(asked.withColumn("part", all_parts), ["key", "part"])
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("query")))
    return met.where(near <= radius).select("query", "fp", near.alias("distance")).distinct()


def edit_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 100, radius: int = 3) -> DataFrame:
    """What digest() gives and, for documents whose id is divisible by `every`, n_near: how many other documents have a fingerprint within `radius` bits."""
    got = materialize(digest(docs, id_col, text_col), "fingerprints")
    number = got.withColumn("fp", F.conv("fingerprint", 16, -10).cast("long"))
    classes = materialize(number.groupBy("fp").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("doc_id") % every == 0, F.lit(False))).alias("asked")), "fingerprint-classes")
    near = near_fingerprints(classes, classes.where("asked"), radius)
    total = near.join(classes.select("fp", "n"), "fp").groupBy(F.col("query").alias("fp")).agg(F.sum("n").alias("total"))
    hot = hot_keys(classes, "fp", "n", classes.agg(F.sum("n")).first()[0] or 0)
    found = salted_join(number, total, "fp", hot, F.monotonically_increasing_id())
    n_near = F.when(F.col("doc_id") % every == 0, F.col("total") - 1).alias("n_near")
    return found.select(*got.columns, n_near)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness to each other and to the next document's.

    One shuffle of the texts, by ranges of the id; the first document of each range is also sent to the range before.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_k"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    bounds = ordered_bounds(slim, "_k", partitions(spark))
    dealt = slim.withColumn("_b", bucket_of(F.col("_k"), bounds))
    firsts = sorted((r["_b"], r["k"]) for r in dealt.groupBy("_b").agg(F.min("_k").alias("k")).collect())  # a row a range
    sent = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    heads = dealt.where(F.col("_k").isin([k for _, k in firsts])).groupBy("_b").agg(F.min(F.struct("_k", "text", "doc_id")).alias("h"))
    to = F.create_map(*[F.lit(x) for kv in sent.items() for x in kv]) if sent else F.create_map()
    heads = heads.select("h._k", "h.doc_id", "h.text", (to[F.col("_b")] if sent else F.lit(0)).alias("_b"), F.lit(1).alias("_next"))
    rows = dealt.withColumn("_next", F.lit(0)).unionByName(heads)
    laid = rows.repartitionById(len(bounds) + 1, F.col("_b")).sortWithinPartitions("_next", "_k", "text").select("_next", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for nxt, d, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                fp = fingerprint(t)
                if held is not None:
                    hd, ht, hf = held
                    n, k = len(ht), len(ht) // 2
                    edited = ht[: n - k] + t[:k]
                    ef = fingerprint(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
                    out.append((hd, n, sha, f"{hf:016x}", f"{ef:016x}", likeness(hf, ef), likeness(hf, fp)))
                held = None if nxt else (d, t, fp)
            if out:
                c = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return laid.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
