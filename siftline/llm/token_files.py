"""Token ids in word-aligned Simple-8b segments.

A segment is one self-contained binary: header, document directory, block offsets, 64-bit words.
The top 4 bits of a word select how many ids of how many bits fill its low 60 bits; blocks of
1024 ids start at a word of their own, whose offset the segment lists, so blocks decode
independently. An id of 2^60 or more is an escape: selector 15, then the id as a raw word.

Segments are rows (part, seg, first, n_ids, n_docs, data) of a Parquet dataset (first: ids before it in its part), so any Hadoop file
system holds them and Spark's commit protocol covers lost executors. Parts follow ascending doc_id.

Defined results: null text is the empty text (one end id); null doc_id sorts first; repeated rows
are written once each, in no promised order among themselves; an empty table gives no segment;
a text longer than a segment makes a segment of its own; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import bucket_of, ordered_bounds, partitions, scratch_path, text_or_empty

MAGIC, BLOCK, ESCAPE = b"S8B1", 1024, 15
#: ids a word holds, by selector 1 to 14; selector 0 is unused.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
_TAKES = np.array([*COUNTS, 1], np.int32)
#: Ids of selector s and below are under _LIMITS[s - 1].
_LIMITS = np.array([1 << (60 // c) for c in COUNTS[1:]], np.uint64)
SEGMENT_IDS = 1 << 18
#: Bytes of text a part holds at least, on average.
PART_BYTES = 1 << 22
_HEAD = struct.Struct("<4sIQIIB7x")


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """(words, word offset of each block and the end, whether escapes occur); greedy within each block."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(1, "<u4"), False
    v = ids.astype(np.uint64)
    need = np.searchsorted(_LIMITS, v, side="right").astype(np.uint8)  # the narrowest selector, less one
    sel = np.where(need < 14, 14, ESCAPE).astype(np.uint8)
    big = need == 14
    left = (BLOCK - np.arange(n) % BLOCK).astype(np.int16)
    widest, had = need, 1
    for s in range(13, 0, -1):  # the widest of c ids from each on, by two windows of the count before
        c = COUNTS[s]
        if c > n:
            break
        widest = np.maximum(widest[: n - c + 1], widest[c - had :])
        ok = (widest < s) & (left[: n - c + 1] >= c)
        if not ok.any():
            break
        sel[: n - c + 1][ok] = s
        had = c
    take = _TAKES[sel]
    starts = np.arange(0, n, BLOCK, dtype=np.int64)
    ends, cur, chains = np.minimum(starts + BLOCK, n), starts.copy(), []
    live = np.arange(len(starts))
    while len(live):  # every block steps by one word at a time, all blocks together
        chains.append(cur[live].copy())
        cur[live] += take[cur[live]]
        live = live[cur[live] < ends[live]]
    is_first = np.zeros(n, bool)
    is_first[np.concatenate(chains)] = True
    first = np.flatnonzero(is_first)
    s, wide = sel[first], big[first]
    width = np.array([0, *(60 // c for c in COUNTS[1:]), 0], np.uint64)
    slots = 1 + wide.astype(np.int64)
    pos = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), "<u8")
    words[pos] = s.astype(np.uint64) << np.uint64(60)
    for k in np.unique(s[~wide]):
        rows = np.flatnonzero((s == k) & ~wide)
        at, word = first[rows], words[pos[rows]]
        for j in range(COUNTS[k]):
            word |= v[at + j] << np.uint64(j * int(width[k]))
        words[pos[rows]] = word
    words[pos[wide] + 1] = v[first[wide]]
    offsets = np.append(pos[np.searchsorted(first, starts)], len(words)).astype("<u4")
    return words, offsets, bool(wide.any())


def unpack_words(words: np.ndarray, n: int, offsets: np.ndarray | None = None) -> np.ndarray:
    """The n ids; `offsets`: of the blocks, where escapes occur. Only blocks with an escape are walked word by word."""
    words = words.astype(np.uint64)
    s = (words >> np.uint64(60)).astype(np.int64)
    is_head = np.ones(len(words), bool)
    if offsets is not None:
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if not (s[lo:hi] == ESCAPE).any():
                continue
            while lo < hi:
                if s[lo] == ESCAPE:
                    is_head[lo + 1] = False
                    lo += 1
                lo += 1
    head = np.flatnonzero(is_head)
    s = s[head]
    counts = np.array([*COUNTS, 1], np.int64)[s]
    start = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for k in np.unique(s):
        rows = np.flatnonzero(s == k)
        if k == ESCAPE:
            out[start[rows]] = words[head[rows] + 1]
            continue
        c = COUNTS[k]
        mask = np.uint64((1 << (60 // c)) - 1)
        for j in range(c):
            out[start[rows] + j] = (words[head[rows]] >> np.uint64(j * (60 // c))) & mask
    return out


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets, escapes = pack_words(ids)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join((
        _HEAD.pack(MAGIC, len(doc_ids), len(ids), BLOCK, len(offsets) - 1, escapes),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), np.array(lengths, "<u8").tobytes(),
        offsets.tobytes(), words.tobytes(),
    ))


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a segment."""
    magic, n_docs, n_ids, _, n_blocks, escapes = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = _HEAD.size
    docs = np.frombuffer(data, "<i8", n_docs, at)
    nulls = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs)
    at += 17 * n_docs
    offsets = np.frombuffer(data, "<u4", n_blocks + 1, at).astype(np.int64)
    words = np.frombuffer(data[at + 4 * (n_blocks + 1) :], "<u8")
    return [None if z else int(d) for d, z in zip(docs, nulls)], lengths.astype(np.int64), unpack_words(words, n_ids, offsets if escapes else None)


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, by its listed offset alone."""
    _, n_docs, n_ids, size, n_blocks, escapes = _HEAD.unpack_from(data)
    at = _HEAD.size + 17 * n_docs
    offsets = np.frombuffer(data, "<u4", n_blocks + 1, at)
    base = at + 4 * (n_blocks + 1)
    words = np.frombuffer(data, "<u8", int(offsets[block + 1] - offsets[block]), base + 8 * int(offsets[block]))
    return unpack_words(words, min(size, n_ids - block * size), np.array([0, len(words)]) if escapes else None)


def write_token_files(df: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode texts in ascending id order into segments under `path`. One shuffle of (id, text); small tables make few parts."""
    size = df.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    bounds = ordered_bounds(df, id_col, min(partitions(df.sparkSession), size // PART_BYTES + 1))
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    laid = slim.repartitionById(len(bounds) + 1, bucket_of(F.col("doc_id"), bounds)).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seg = bpe.encoder(tokenizer), TaskContext.get().partitionId(), 0
        docs, sizes, held, n, first = [], [], [], 0, 0
        end = np.array([end_id], "<u4").tobytes()

        def flush():
            data = write_segment(docs, sizes, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([n], pa.int64()), "n_docs": pa.array([len(docs)], pa.int64()), "data": pa.array([data], pa.binary())})

        for b in batches:
            for lo in range(0, b.num_rows, 64):
                some = b.slice(lo, 64)
                for d, x in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    k = len(x) // 4 + 1
                    if n and n + k > SEGMENT_IDS:
                        yield flush()
                        docs, sizes, held, n, seg, first = [], [], [], 0, seg + 1, first + n
                    docs.append(d)
                    sizes.append(k)
                    held += (x, end)
                    n += k
        if n:
            yield flush()

    laid.mapInArrow(encode, "part int, seg int, first long, n_ids long, n_docs long, data binary").write.parquet(path, compression="none")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, part, seg."""
    segs = spark.read.schema("part int, seg int, first long, n_ids long, n_docs long, data binary").parquet(path)
    starts, total = {}, 0
    for part, n in sorted(tuple(r) for r in segs.groupBy("part").agg(F.sum("n_ids")).collect()):  # a row a part
        starts[part] = total
        total += n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part, seg = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                begin = starts[part] + b.column(2)[i].as_py()
                docs, lengths, ids = read_segment(b.column(3)[i].as_py())
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs, pa.int64()), "start": pa.array(begin + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array([part] * len(docs), pa.int32()), "seg": pa.array([seg] * len(docs), pa.int32()),
                })

    return segs.select("part", "seg", "first", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seg int")


def token_digest(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and return what reading them back gives."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer or bpe.public_path("byte_bpe_50k.json"), path, end_id)
    return read_token_files(docs.sparkSession, path)


