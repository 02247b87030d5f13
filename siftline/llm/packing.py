"""Packing by cutting-stock column generation.

Documents are cut into whole sequences and one remainder each; the remainders' length histogram
(at most seq_len / grain classes, so bounded whatever the corpus) is the demand of a linear program
over patterns of one sequence. Its dual prices enter an unbounded-knapsack dynamic program that
yields the next column, until none improves. Patterns are rounded down and assigned to ranked
pieces; what rounding leaves (less than one sequence a pattern) is filled by the same dynamic
program over what is left. Only counts of classes reach the driver; ids are never shuffled.

Defined results: null or empty text is the end id alone; repeated rows are packed once each; an
empty table gives no piece; very long texts give many whole sequences; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, partitions, text_or_empty


def price(values: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: counts by class (class c weighs c + 1) that fit `capacity` at the best value."""
    best, via = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        worth = values[:c] + best[c - 1 :: -1][:c]
        k = int(np.argmax(worth))
        best[c] = best[c - 1]
        if worth[k] > best[c] + 1e-12:
            best[c], via[c] = worth[k], k
    out, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if via[c] < 0:
            c -= 1
        else:
            out[via[c]] += 1
            c -= via[c] + 1
    return out


def solve(demand: np.ndarray, capacity: int, rounds: int = 4000, gap: float = 4e-3) -> list[tuple[np.ndarray, float]]:
    """Patterns and amounts of the cutting-stock program, by the revised simplex method with generated columns."""
    used = np.flatnonzero(demand)
    m = len(used)
    if not m:
        return []
    weights, d = used + 1, demand[used].astype(float)
    cols = np.diag((capacity // weights).astype(float))
    inv, x = np.diag(1 / np.diag(cols)), d / np.diag(cols)
    full = np.zeros(capacity)
    for r in range(rounds):
        y = inv.sum(axis=0)
        full[:] = 0
        full[used] = y
        col = price(full, capacity)[used].astype(float)
        value = float(col @ y)
        # y / value is a feasible dual, so its value bounds the optimum from below
        if value <= 1 + 1e-9 or float(y @ d) / value >= (1 - gap) * x.sum():
            break
        step = inv @ col
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.full(m, np.inf)
        ratio[ok] = x[ok] / step[ok]
        out = int(np.argmin(ratio))
        t = ratio[out]
        x = np.maximum(x - t * step, 0)
        x[out] = t
        cols[:, out] = col
        pivot = inv[out] / step[out]
        inv = inv - np.outer(step, pivot)
        inv[out] = pivot
        if r % 200 == 199:
            inv = np.linalg.inv(cols)
            x = np.maximum(inv @ d, 0)
    plans = []
    for j in range(m):
        if x[j] > 0:
            p = np.zeros(capacity, np.int64)
            p[used] = np.rint(cols[:, j]).astype(np.int64)
            plans.append((p, float(x[j])))
    return plans


def fill(left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """One sequence after another from what rounding left: the largest piece, then the fullest bounded sum with it."""
    left, out = left.copy(), []
    while left.any():
        p, room = np.zeros(capacity, np.int64), capacity
        top = int(np.flatnonzero(left)[-1])
        p[top] += 1
        room -= top + 1
        reach, via = np.zeros(room + 1, bool), {}
        reach[0] = True
        for c in range(min(top, room - 1), -1, -1):
            have = int(left[c] - (c == top))
            for _ in range(min(have, room // (c + 1))):
                new = np.flatnonzero(reach[: room - c] & ~reach[c + 1 :]) + c + 1
                if not len(new):
                    break
                for k in new.tolist():
                    via[k] = c
                reach[new] = True
            if reach[room]:
                break
        at = int(np.flatnonzero(reach)[-1])
        while at:
            p[via[at]] += 1
            at -= via[at] + 1
        if (p > left).any():  # a chain may use a class again through another: keep only what is there
            p = np.minimum(p, left)
        left -= p
        out.append(p)
    return out


def layout(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns and how often each is used; together they hold exactly the demand."""
    left, plan = demand.copy(), []
    for p, amount in sorted(solve(demand, capacity), key=lambda q: -q[1]):
        n = int(amount + 1e-7)
        for c in np.flatnonzero(p):
            n = min(n, int(left[c] // p[c]))
        if n > 0:
            plan.append((p, n))
            left -= n * p
    return plan + [(p, 1) for p in fill(left, capacity)]


def pieces(docs: DataFrame, tokenizer: str, seq_len: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: whole sequences and a remainder for each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = bpe.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some, rows = b.slice(lo, 256), []
                for d, x in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    x += end
                    n = len(x) // 4
                    for s in range(0, n, seq_len):
                        y = x[4 * s : 4 * (s + seq_len)]
                        rows.append((d, s, len(y) // 4, zlib.crc32(y), n))
                names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows)], names=list(names))

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str | None = None, seq_len: int = 2048, end_id: int = 1, grain: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their sequence_id and offset. `grain`: lengths are rounded up to it for the program only."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer or bpe.public_path("word_bpe_49k.json"), seq_len, end_id, id_col, text_col), "pieces")
    capacity = seq_len // grain
    dealt = max(16, partitions(spark))
    cut = cut.withColumn("_class", F.ceil(F.col("length") / grain).cast("int") - 1).withColumn("_deal", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(dealt)).cast("int"))
    # capacity x dealt counts at most
    counts = cut.groupBy("_class", "_deal").count().collect()
    demand = np.zeros(capacity, np.int64)
    for c, _, n in counts:
        demand[c] += n
    base: dict[tuple[int, int], int] = {}
    seen = np.zeros(capacity, np.int64)
    for c, k, n in sorted(counts):
        base[c, k] = int(seen[c])
        seen[c] += n
    # ranks of a class -> (first rank, pieces a sequence, first sequence), one entry a pattern that uses the class
    plan: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity)]
    at, n_seq = np.zeros(capacity, np.int64), 0
    for p, n in layout(demand, capacity):
        for c in np.flatnonzero(p):
            plan[c].append((int(at[c]), int(p[c]), n_seq))
            at[c] += n * p[c]
        n_seq += n
    plan_arrays = {c: np.array(x, np.int64) for c, x in enumerate(plan) if x}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, deal, rank = (b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("_class", "_deal", "_rank"))
            seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                rows = np.flatnonzero(cls == c)
                r = rank[rows] - 1 + np.array([base[c, k] for k in deal[rows].tolist()], np.int64)
                t = plan_arrays[int(c)]
                e = t[np.searchsorted(t[:, 0], r, "right") - 1]
                seq[rows] = e[:, 2] + (r - e[:, 0]) // e[:, 1]
                slot[rows] = (capacity - c) * 4096 + (r - e[:, 0]) % e[:, 1]
            cols = [b.column(b.schema.get_field_index(k)) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(slot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "_slot"])

    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("_class", "_deal").orderBy("doc_id", "start", "ids_crc32")))
    placed = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, _slot long")
    inner = Window.partitionBy("sequence_id").orderBy("_slot")
    upto = F.sum("length").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("offset", upto - F.col("length")).drop("_slot")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def padding(packed: DataFrame, seq_len: int = 2048) -> DataFrame:
    """Tokens, sequences and padded positions of a packing; a sequence at a power of two is not padded."""
    n = F.col("n")
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(seq_len) - n)
    return per.agg(F.sum("n").alias("tokens"), F.count("*").alias("sequences"), F.sum(pad).alias("padded"))
