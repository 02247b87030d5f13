import collections
import hashlib
import itertools
import math
import re
import tracemalloc

import numpy as np
import pytest
import xxhash

from siftline.llm import components, fingerprints, simhash_dedup, suffix_dedup


def brute_majority(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius=3):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(fps))]


def test_dedup_against_brute_force(docs, empty):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is None, r[0] or 0))
    fps = [brute_majority(r[1]) for r in rows]
    top = groups(fps)
    want = sorted((r[0] is None, r[0] or 0, f"{f:016x}", -1 if rows[t][0] is None else rows[t][0]) for r, f, t in zip(rows, fps, top))
    got = simhash_dedup.dedup(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert simhash_dedup.dedup(empty).count() == 0


def test_anchors_link_what_brute_force_links(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 150).astype(np.int64)
    near = base.repeat(8)
    for i in range(len(near)):
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            near[i] ^= np.array(1 << int(b), np.uint64).astype(np.int64)
    dense = np.array([sum(1 << int(b) for b in rng.integers(0, 12, 3)) for _ in range(300)], np.int64)
    fps = sorted(set(np.concatenate([base, near, dense, [0, -1]]).tolist()))
    links = simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    for u, v in links:
        assert ((u ^ v) & (2**64 - 1)).bit_count() <= 3
    want = groups([f & (2**64 - 1) for f in fps])
    root = {r.node: r.root for r in components.components(spark.createDataFrame([(u, v) for u, v in links], "u long, v long")).collect()}
    assert [root.get(f, f) for f in fps] == [fps[t] for t in want]


def brute_fingerprint(text):
    words = (text or "").lower().split()
    if not words:
        return 0
    sh = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or [" ".join(words)]
    weight = {s: 1 + math.log(n) for s, n in collections.Counter(sh).items()}
    h = {s: xxhash.xxh64_intdigest(s.encode(), 42) for s in weight}
    return sum(1 << b for b in range(64) if sum(w if h[s] >> b & 1 else -w for s, w in weight.items()) > 1e-9)


def test_fingerprints_and_block_tables_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = lambda n: " ".join(rng.choice(["ab", "cd", "Ef", "gh"], n)) if n % 3 else " ".join(str(rng.integers(999)) for _ in range(n))
    for t in [words(int(rng.integers(0, 60))) for _ in range(60)] + ["", None, "one two"]:
        assert fingerprints.fingerprint(t) == brute_fingerprint(t), t
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    fps += [f ^ sum(1 << b for b in {int(x) for x in rng.integers(0, 62, k)}) for f in fps for k in (1, 2, 3, 4)]
    fps += [(7 << 40) | int(x) for x in rng.integers(0, 256, 80)] + [0, -1]
    want = {(q, f, ((q ^ f) & (2**64 - 1)).bit_count()) for q in fps[::7] for f in fps if ((q ^ f) & (2**64 - 1)).bit_count() <= 3}
    for hot in (None, lambda counts, key, n, total: [r[0] for r in counts.where("n > 20").select(key).collect()]):
        if hot:
            monkeypatch.setattr(fingerprints, "hot_keys", hot)
        near = fingerprints.near_fingerprints(spark.createDataFrame([(f,) for f in fps] * 2, "fp long"), spark.createDataFrame([(f,) for f in fps[::7]], "fp long")).collect()
        assert {tuple(p) for p in near} == want and len(near) == len(want)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edit_digest(docs, empty, spark):
    plain = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(plain.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprints.edit_digest(plain, every=7).collect()}
    assert len(got) == len(rows)
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        t, nxt, r = t or "", nxt or "", got[d]
        k = len(t) // 2
        edited = t[: len(t) - k] + nxt[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, b = (fingerprints.fingerprint(x) for x in (t, edited, nxt))
        assert (r.fingerprint, r.edited_fingerprint) == (f"{a:016x}", f"{e:016x}")
        assert r.near_edited == fingerprints.likeness(a, e) and r.near_next == fingerprints.likeness(a, b)
        same = sum((a ^ fingerprints.fingerprint(x[1])).bit_count() <= 3 for x in rows) - 1
        assert r.n_near == (same if d % 7 == 0 else None)
    assert fingerprints.edit_digest(docs).count() == docs.count()
    assert fingerprints.edit_digest(empty).count() == 0
    one = fingerprints.edit_digest(plain.where("doc_id = 2")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def brute_repeats(rows, least=100):
    seen, out = set(), []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            w = raw[p : p + least]
            if w in seen:
                gone[p : p + least] = b"\1" * least
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def test_repeats_against_brute_force(docs, empty):
    plain = docs.dropDuplicates(["doc_id"])
    rows = sorted(plain.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = suffix_dedup.remove_repeats(plain).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_repeats(rows), key=key)
    assert any(r.n_removed for r in got)
    assert suffix_dedup.remove_repeats(docs).count() == docs.count()
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("parts", [2, 13])
def test_repeats_over_segment_and_range_ends(spark, parts):
    """Few letters and shared passages, small segments, ranges whose ends cut hot ranks."""
    rng = np.random.default_rng(4)
    pieces = ["".join(rng.choice(list("abcdefgh"), n)) for n in (300, 130, 700, 99, 101)]
    texts = ["".join(pieces[i] for i in rng.integers(0, 5, rng.integers(1, 9))) for _ in range(25)] + ["xy" * 900, "z" * 2500]
    line = "".join(rng.choice(list("abc"), 80))
    texts += [f"{i}".zfill(9) + line + f"{i * 7}".zfill(12) + pieces[0][i % 90 :][:60] for i in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), segment=1 << 10).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted(tuple(r) for r in got) == brute_repeats(rows)


def test_repeats_among_texts_of_one_doc_id(spark):
    """Texts that share a doc_id, or have none, are documents in the order of their hashes; identical rows are one."""
    rng = np.random.default_rng(6)
    piece = "".join(rng.choice(list("abcdefgh"), 150))
    rows = [(d, "".join(rng.choice(list("abcdefgh"), 50)) + piece[: 100 + 10 * i]) for d in (None, 3, 3, 5) for i in range(5)]
    rows += [rows[0]] * 4 + [rows[7]] * 3
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    once = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = dict(zip(once, brute_repeats(once)))
    key = lambda r: (r[0] is not None, *(x or 0 for x in r[:4]), r[4])
    assert sorted(map(tuple, got), key=key) == sorted((want[r] for r in rows), key=key)


def test_names_and_anchors_are_made_in_small_blocks():
    """The whole names and anchors of a full buffer, without further arrays of its size on the way."""
    buf = np.random.default_rng(4).integers(97, 100, suffix_dedup.SEGMENT - 1).astype(np.uint8)
    ends = np.array([len(buf)])
    tracemalloc.start()
    at, lo, hi, name, _ = suffix_dedup.runs(buf, ends)
    h = suffix_dedup.names(buf)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    assert (suffix_dedup.names(buf) == h).all()
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 2 * h.nbytes
    rough = np.uint64(suffix_dedup.SEGMENT - 1)
    key = (h & ~rough) | np.arange(len(h), dtype=np.uint64)
    start = np.concatenate([np.arange(a - d, a - c + 1) for a, c, d in zip(at, lo, hi)])
    assert (start == np.arange(len(buf) - suffix_dedup.LEAST + 1)).all()
    least = np.lib.stride_tricks.sliding_window_view(key, suffix_dedup.SPAN).argmin(axis=1) + start
    assert (np.repeat(at, hi - lo + 1) == least).all() and (name == h[at]).all()


def test_range_ends_join_ranks():
    import pyarrow as pa

    a, c = np.array([1, 1, 5, 5, 5, 9]), np.array([0, 7, 1, 4, 9, 2])
    bounds = (np.array([1, 5, 5]), np.array([5, 0, 5]))
    assert suffix_dedup.splitter(a, c, bounds).tolist() == [sum((x, y) <= (p, q) for x, y in zip(*bounds)) for p, q in zip(a, c)]
    out = []
    for task, rows in enumerate([[(1, 1), (2, 1), (2, 2)], [(2, 3)], [(2, 4), (3, 1), (3, 2), (4, 4)]]):
        t = pa.table({"a": [r[0] for r in rows], "c": [r[1] for r in rows], "k": [task] * len(rows), "at": list(range(len(rows))), "shape": pa.array([0] * len(rows), pa.int32())})
        judged = pa.Table.from_batches(list(suffix_dedup._rank()(t.to_batches()))).to_pylist()
        out.append([(r["kind"], r["rank"]) for r in judged])
    asked = [[r for k, r in x if k == suffix_dedup.ASKED] for x in out]
    assert asked == [[0, 1, 1], [0], [0, 1, 1, 2]]
