"""SimHash near-duplicates by anchor points.

Fingerprints link at `radius` (3) or fewer differing bits. Of two linked fingerprints, one 32-bit half
differs in at most one bit. On 31 bits of each half the Hamming code is a covering code of radius 1:
its words are the anchors. Every fingerprint is replicated to all anchors within 1 + 1 bits of its half
(16 of them, or itself alone), so a linked pair meets at the anchor nearest to either; whole
fingerprints are compared there. An anchor emits a spanning forest of its links, not all pairs.
Equal fingerprints are one class before that, so groups of copies cost one row.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; texts of
under three words are one shingle; a null doc_id is never the smallest of a group that has another;
repeated rows are returned as often as they come; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialize, partitions, salted_join, text_or_empty
from .components import components
from .shingles import ascii_words, bit_sums, pack_bits, shingle_hashes, signed

WORDS, RADIUS = 3, 3
_ONES = (1 << 31) - 1
#: By syndrome, the flips that lead to all anchors within two bits, padded with the first.
_FLIPS = np.zeros((32, 16), np.int64)
for _s in range(1, 32):
    _FLIPS[_s] = [1 << (_s - 1), *((1 << (i - 1)) | (1 << ((i ^ _s) - 1)) for i in range(1, 32) if i < i ^ _s)]
_MASKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> b & 1) for b in range(5)]


def majority(text: str | None, k: int = WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; no words: zero."""
    h = shingle_hashes(ascii_words(text or ""), k)
    return pack_bits(2 * bit_sums(h) > len(h)) if len(h) else 0


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all anchors within two bits of 31-bit values."""
    syndrome = sum((np.bitwise_count(half & m).astype(np.int64) & 1) << b for b, m in enumerate(_MASKS))
    out = half[:, None] ^ _FLIPS[syndrome]
    keep = np.ones(out.shape, bool)
    keep[syndrome == 0, 1:] = False
    row, col = np.nonzero(keep)
    return row, out[row, col]


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of longs (unsigned: a signed count would take absolute values)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect whatever links of at most `radius` bits connect among distinct fingerprints."""
    left, out = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = bits_apart(left, x) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                out.extend((int(x), int(y)) for y in found)
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: links of each cell."""
    cell, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(c)) + 1
        starts, ends = np.append(0, edges), np.append(edges, len(c))
        pair = ends - starts == 2
        a, b = f[starts[pair]], f[starts[pair] + 1]
        near = (bits_apart(a, b) <= RADIUS) & (a != b)
        us, vs = [a[near]], [b[near]]
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            got = forest(np.unique(f[s:e]))
            if got:
                x = np.array(got, np.int64)
                us.append(x[:, 0])
                vs.append(x[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    for b in batches:
        cell = np.concatenate([cell, b.column(0).to_numpy()])
        fp = np.concatenate([fp, b.column(1).to_numpy()])
        if len(cell) < 200_000:
            continue
        last = int(np.searchsorted(cell, cell[-1], "left"))  # the last cell may go on
        if last:
            yield links(cell[:last], fp[:last])
            cell, fp = cell[last:], fp[last:]
    if len(cell):
        yield links(cell, fp)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy()
        for lo in range(0, len(fp), 20_000):
            some, cells, rows = fp[lo : lo + 20_000], [], []
            for half in (0, 1):
                row, anchor = anchors((some >> (32 * half)) & _ONES)
                cells.append(anchor | (half << 31))
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(some[np.concatenate(rows)])], names=["cell", "fp"])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) links between distinct fingerprints that connect all groups."""
    n = partitions(distinct.sparkSession)
    dealt = distinct.select("fp").mapInArrow(_replicate, "cell long, fp long").repartition(n, "cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(_meet, "u long, v long")


def near_pairs(texts: DataFrame, k: int = WORDS) -> DataFrame:
    """u, v: links that connect all texts whose fingerprints chains of `RADIUS` bits connect. `texts`: node (long, unique), text (not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [signed(majority(t, k)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["node", "fp"])

    fps = materialize(texts.select("node", "text").mapInArrow(run, "node long, fp long"), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "simhash-classes")
    firsts = classes.select("fp", "first").hint("merge")
    between = materialize(links(classes).distinct(), "simhash-links")
    for end, other in (("u", "v"), ("v", "u")):
        often = between.groupBy(end).agg(F.count("*").alias("n"))
        between = salted_join(between, firsts.withColumnsRenamed({"fp": end, "first": f"{end}_first"}), end, hot_keys(often, end, "n", between.count()), F.col(other), how="inner")
    equal = salted_join(fps, firsts, "fp", hot_keys(classes, "fp", "n", fps.count()), F.col("node"), how="inner").where("node <> first")
    both = between.select(F.col("u_first").alias("first"), F.col("v_first").alias("node")).unionByName(equal.select("first", "node"))
    return both.select(F.least("first", "node").alias("u"), F.greatest("first", "node").alias("v"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, component_id for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [signed(majority(t, k)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    fps = materialize(slim.mapInArrow(run, "doc_id long, fp long"), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    roots = components(links(classes))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    n_docs, n_roots = rooted.agg(F.sum("n"), F.count("*")).first()
    by_fp = salted_join(rooted.select("root", "fp"), least.drop("members"), "root", hot_keys(least, "root", "members", n_roots or 0), F.col("fp"))
    out = salted_join(fps, by_fp.select("fp", "component_id"), "fp", hot_keys(classes, "fp", "n", n_docs or 0), F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
