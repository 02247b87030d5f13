"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash anchors of the sets' fingerprints (simhash_dedup.py) give the first candidates, which reach what is alike within
3 bits; they are compared by their whole sets like all others, so they link nothing that is less alike. The rest is
found by prefix filtering, which is complete by itself: put every text's n shingles in one global order, and two texts of similarity
s share a shingle among the first n - ceil(s n) + 1 of each. Shingles that a bounded draw of texts shows often
come last in that order, so boilerplate rarely stands in a prefix; any order is complete, the draw only
saves work. Texts that meet at a shingle, and whose lengths, positions and signs allow s, are compared by their whole
sets (a sign has the parity of a set's shingles in each of 1,024 cells: two sets differ in as many shingles at
least as their signs in cells, so the bound loses no pair), in rounds between which what is alike becomes one group, and only members of different groups are
compared further: each meeting's members against its first; against a few members of one random order that
all meetings share; against those that are alike to most; last, all that are left against each other. So a large group of
near copies costs a few comparisons a member, though its members be alike in part only.

Defined results: words are those of shingles.py; texts of under five words are one shingle; texts without
words are alike; equal sets are alike; a group is what links of s or more connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialize, partitions
from .components import components
from .simhash_dedup import near_pairs
from .shingles import ascii_words, shingle_hashes

WORDS, LEAST = 5, 0.8
#: Draw for the order: texts, and shingles that are put last.
DRAWN, LAST = 20_000, 50_000
#: A meeting of many texts is dealt over the pairs of this many parts.
PARTS = 8
#: Members of a meeting that all others are held against: of the random order, and of those alike to most (the former are among them).
PIVOTS = (12, 60)
#: Cells of a sign.
CELLS = 1024
_EPS = 1e-9


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; a text without words has the one shingle 0."""
    h = np.unique(shingle_hashes(ascii_words(text or ""), words).view(np.int64))
    return h if len(h) else np.zeros(1, np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _may(na: np.ndarray, ia: np.ndarray, nb: np.ndarray, ib: np.ndarray, least: float) -> np.ndarray:
    """Whether texts of na and nb shingles whose first common one is at ia and ib can reach `least`."""
    most = np.minimum(na - ia, nb - ib)
    return most + _EPS >= least / (1 + least) * (na + nb)


def sign(h: np.ndarray) -> bytes:
    """The parity of a set of shingles in each cell."""
    return np.packbits(np.bincount(h & (CELLS - 1), minlength=CELLS) & 1 == 1).tobytes()


def _signs_may(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these signs and sizes can reach `least`: of na + nb they differ in (1 - s) / (1 + s) at most."""
    return np.bitwise_count(a ^ b).sum(axis=-1) <= (1 - least) / (1 + least) * (na + nb) + _EPS


def _postings(texts: DataFrame, words: int, least: float) -> DataFrame:
    """sh, node, n, at: the prefix of each text in the global order; each text's first row has its sign."""
    n_texts = texts.count()
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(1, -(-n_texts // DRAWN)))) == 0).select("text")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 200):
                got = [shingle_set(t, words) for t in b.column(0).slice(lo, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got))], names=["sh"])

    often = drawn.mapInArrow(every, "sh long").groupBy("sh").count().where("count > 2").orderBy(F.desc("count"), "sh").limit(LAST).collect()
    pairs = sorted((r["sh"], r["count"]) for r in often)
    shared = texts.sparkSession.sparkContext.broadcast((np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for b in batches:
            for lo in range(0, len(b), 500):
                sh, node, size, at, signs = [], [], [], [], []
                for k, t in zip(b.column(0).slice(lo, 500).to_pylist(), b.column(1).slice(lo, 500).to_pylist()):
                    h = shingle_set(t, words)
                    rank = np.zeros(len(h), np.int64)
                    if len(known):
                        i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        rank = np.where(known[i] == h, count[i], 0)
                    n = len(h)
                    keep = n - int(np.ceil(least * n - _EPS)) + 1
                    sh.append(h[np.argsort(rank, kind="stable")[:keep]])  # h is sorted: ties by hash
                    node.append(np.full(keep, k, np.int64))
                    size.append(np.full(keep, n, np.int32))
                    at.append(np.arange(keep, dtype=np.int32))
                    signs += [sign(h), *[None] * (keep - 1)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in (sh, node, size, at)), pa.array(signs, pa.binary())], names=["sh", "node", "n", "at", "sign"])

    return texts.select("node", "text").mapInArrow(first, "sh long, node long, n int, at int, sign binary")


def _words(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), CELLS // 64)


class _Runs:
    """Rows sorted by their first `keys` columns, as whole runs of equal keys."""

    def __init__(self, keys: int):
        self.keys = keys

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        held: list[np.ndarray] | None = None
        for b in batches:
            new = [_words(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) < 100_000:
                continue
            cuts = self._cuts(held)
            if len(cuts) > 2:
                yield [c[: cuts[-2]] for c in held], cuts[:-1]
                held = [c[cuts[-2] :] for c in held]
        if held is not None and len(held[0]):
            yield held, self._cuts(held)

    def _cuts(self, cols: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[: self.keys]:
            new |= np.diff(c) != 0
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(cols[0])]])


def _pairs(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    u, v = np.concatenate([*us, np.zeros(0, np.int64)]), np.concatenate([*vs, np.zeros(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _held(met: DataFrame, least: float, pivots: int, hot: list[int]) -> DataFrame:
    """u, v: members of a meeting, of another group than the pivot's, with each of its `pivots` first by turn. `met`: sh, turn, node, n, at, root and, if known, sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, node, n, at, root, *known), cuts in _Runs(2)(batches):
            size = np.diff(cuts)
            for r in range(min(pivots, int(size.max()))):
                first = np.repeat(np.where(size > r, cuts[:-1] + r, cuts[:-1]), size)
                ok = np.flatnonzero((root[first] != root) & _may(n[first], at[first], n, at, least))
                for signs in known:
                    ok = ok[_signs_may(signs[first[ok]], n[first[ok]], signs[ok], n[ok], least)]
                yield _pairs([node[first][ok]], [node[ok]])

    # the parts of a large meeting have pivots of their own
    part = F.when(F.col("sh").isin(hot), F.pmod(F.xxhash64("node"), F.lit(PARTS))).otherwise(F.lit(0)) if hot else F.lit(0)
    dealt = met.withColumn("part", part).repartition(partitions(met.sparkSession), "sh", "part").sortWithinPartitions("sh", "part", "turn", "node")
    return dealt.select("sh", "part", "turn", "node", "n", "at", "root", *{"sign"}.intersection(met.columns)).mapInArrow(run, "u long, v long").distinct()


def _crossings(met: DataFrame, least: float) -> DataFrame:
    """u, v: members of a meeting that are not in one group. `met`: sh, part, node, n, at, root, sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, node, n, at, root, signs), cuts in _Runs(2)(batches):
            us, vs, held = [], [], 0
            for s, e in zip(cuts[:-1], cuts[1:]):
                for i in range(s, e - 1):  # by n: none beyond n / least can be alike
                    stop = s + int(np.searchsorted(n[s:e], n[i] / least + _EPS, "right"))
                    other = slice(i + 1, stop)
                    ok = np.flatnonzero((root[other] != root[i]) & (node[other] != node[i]) & _may(n[i], at[i], n[other], at[other], least)) + i + 1
                    ok = ok[_signs_may(signs[i], n[i], signs[ok], n[ok], least)]
                    if len(ok):
                        vs.append(node[ok])
                        us.append(np.full(len(vs[-1]), node[i]))
                        held += len(vs[-1])
                    if held > 500_000:
                        yield _pairs(us, vs)
                        us, vs, held = [], [], 0
            yield _pairs(us, vs)

    dealt = met.repartition(partitions(met.sparkSession), "sh", "part").sortWithinPartitions("sh", "part", "n", "node")
    return dealt.select("sh", "part", "node", "n", "at", "root", "sign").mapInArrow(run, "u long, v long").distinct()


def _alike(pairs: DataFrame, texts: DataFrame, words: int, least: float, name: str) -> DataFrame:
    """The pairs whose whole sets reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for b in batches:
            keep = []
            for i in range(len(b)):
                u = b.column(0)[i].as_py()
                if u != last:
                    last, a = u, shingle_set(b.column(2)[i].as_py(), words)
                if jaccard(a, shingle_set(b.column(3)[i].as_py(), words)) + _EPS >= least:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], names=["u", "v"])

    # merge joins at every size: the pairs grow with the input and are never broadcast
    right = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")).hint("merge"), "v")
    both = right.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")).hint("merge"), "u")
    return materialize(both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long"), name)


def groups(texts: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(node, root) of every text that is like another. `texts`: node (long, unique), text (not null), read more than once."""
    post = materialize(_postings(texts, words, least), "near-prefixes")
    signs, post = post.where("sign IS NOT NULL").select("node", "sign"), post.drop("sign")
    often = materialize(post.groupBy("sh").agg(F.count("*").alias("m")).where("m > 1"), "near-meetings")
    met = materialize(post.join(often.select("sh").hint("merge"), "sh", "left_semi"), "near-met")
    held = _held(met.withColumns({"turn": F.lit(0).cast("long"), "root": F.col("node")}), least, 1, hot_keys(often, "sh", "m", met.count(), share=0.001))
    pairs = materialize(held.unionByName(near_pairs(texts, words)).distinct(), "near-pairs")
    links = _alike(pairs, texts, words, least, "near-links")
    for turn, pivots in ((F.xxhash64("node"), PIVOTS[0]), (-F.coalesce("degree", F.lit(0)), PIVOTS[1])):
        left, hot = _open(met, components(links), signs)
        ends = links.select("u").unionByName(links.select(F.col("v").alias("u")))
        degree = ends.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
        held = _held(left.join(degree.hint("merge"), "node", "left").withColumn("turn", turn), least, pivots, hot)
        new = materialize(held.join(pairs.hint("merge"), ["u", "v"], "left_anti"), "near-pairs")
        pairs, links = pairs.unionByName(new), links.unionByName(_alike(new, texts, words, least, "near-links"))
    left, hot = _open(met, components(links), signs)
    mine = F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")
    deal = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda x: F.least(mine, x) * PARTS + F.greatest(mine, x))
    part = F.explode(F.when(F.col("sh").isin(hot), deal).otherwise(F.array(F.lit(0)))) if hot else F.lit(0)
    crossed = materialize(_crossings(left.withColumn("part", part), least), "near-crossed").join(pairs.hint("merge"), ["u", "v"], "left_anti")
    return components(links.unionByName(_alike(crossed, texts, words, least, "near-links")))


def _open(met: DataFrame, roots: DataFrame, signs: DataFrame) -> tuple[DataFrame, list[int]]:
    """(sh, node, n, at, root, sign of the meetings that have members of more than one group; of those, the shingles of large ones)."""
    rooted = met.join(materialize(roots, "near-roots").hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted.select("sh", "node", "n", "at", "root"), "near-rooted")
    open_ = rooted.groupBy("sh").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m")).where("a < b")
    open_ = materialize(open_.select("sh", "m"), "near-open")
    hot = hot_keys(open_, "sh", "m", rooted.count(), share=0.001)
    return rooted.join(open_.select("sh").hint("merge"), "sh", "left_semi").join(signs.hint("merge"), "node"), hot
