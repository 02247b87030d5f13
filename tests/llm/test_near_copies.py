import itertools

import numpy as np

import corpus_pipeline
from siftline.llm import near_copies, simhash_dedup


def edited(rng, words, share):
    return [str(rng.integers(10**9)) if rng.random() < share else w for w in words]


def test_near_copies_against_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = ["", "  ", "one two", "One TWO", "one two three"]
    line = [f"line{i}" for i in range(30)]
    for _ in range(30):
        words = [str(rng.integers(10**9)) for _ in range(rng.integers(20, 400))]
        words = words + line if rng.random() < 0.5 else words
        texts.append(" ".join(words))
        texts += [" ".join(edited(rng, words, s)) for s in (0.005, 0.01, 0.02, 0.03, 0.05, 0.1)]
    sets = [near_copies.shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        return i if up[i] == i else top(up[i])

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        if len(a & b) >= 0.8 * len(a | b):
            up[max(top(i), top(j))] = min(top(i), top(j))
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {r.node: r.root for r in near_copies.groups(rows).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == [top(i) for i in range(len(texts))]
    assert len({top(i) for i in range(len(texts))}) < 150
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({top(i) for i in range(len(texts))})


def test_a_large_group_and_hot_meetings(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "hot_keys", lambda counts, key, n, total, share: [r[0] for r in counts.where("m > 5").select(key).collect()])
    rng = np.random.default_rng(2)
    base = [str(rng.integers(10**9)) for _ in range(60)]
    texts = [" ".join(base[:40] + [str(rng.integers(10**9)) for _ in range(s)]) for s in (0, 1, 2, 3, 9, 12, 15, 20) for _ in range(8)]
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    near = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {r.node: r.root for r in near_copies.groups(spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect()}
    assert near and all(got[i] == got[j] for i, j in near)
    assert set(got) == {x for p in near for x in p}


def test_rows_that_share_a_doc_id_or_have_none(spark):
    rng = np.random.default_rng(3)
    text = lambda: " ".join(str(rng.integers(10**9)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(3, a, "x"), (5, a + " more", "x"), (5, b, "x"), (7, c, "y"), (7, c, "x"), (7, d, "x"), (None, d, "x"), (None, e, "x"), (None, text(), "x"), (None, e, "x"), (9, None, "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    left = [got.remove(r) or r for r in [rows[0], rows[2], rows[5], rows[7], rows[8], rows[11]]]
    assert len(left) == 6 and len(got) == 1 and got[0] in rows[3:5]


def test_texts_of_common_passages_are_not_paired(spark, monkeypatch):
    # no two alike, yet each passage is in half of the texts: without signs, pairs grow with the square of their number
    rng = np.random.default_rng(7)
    passages = [" ".join(str(rng.integers(10**9)) for _ in range(30)) for _ in range(8)]
    texts = [" ".join([passages[j] for j in rng.permutation(8)[:4]] + [str(rng.integers(10**9)) for _ in range(60)]) for _ in range(200)]
    sets = [near_copies.shingle_set(t) for t in texts]
    words = [np.frombuffer(near_copies.sign(h), np.uint64) for h in sets]
    for a, b in itertools.combinations(range(60), 2):
        apart = len(np.setxor1d(sets[a], sets[b]))
        assert np.bitwise_count(words[a] ^ words[b]).sum() <= apart
    monkeypatch.setattr(near_copies, "LAST", 0)  # as for passages that the draw does not show: they stand in prefixes
    held, was = [], near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, *more: held.append(pairs.count()) or was(pairs, *more))
    assert near_copies.groups(spark.createDataFrame(list(enumerate(texts)), "node long, text string")).count() == 0
    assert sum(held[1:]) < 200


def test_anchors_give_candidates_that_whole_sets_confirm(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = [[str(rng.integers(10**9)) for _ in range(400)] for _ in range(6)]
    texts = [" ".join(w) for w in base] + [" ".join(w[:200] + ["other"] + w[201:]) for w in base] + ["one two", "ONE two ", ""]
    fps = [simhash_dedup.majority(t, near_copies.WORDS) for t in texts]
    near = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert len(near & {(i, i + 6) for i in range(6)}) >= 3
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    none = spark.createDataFrame([], "sh long, node long, n int, at int, sign binary")
    monkeypatch.setattr(near_copies, "_postings", lambda *_: none)  # no candidates by prefixes
    roots = {r.node: r.root for r in near_copies.groups(rows).collect()}
    assert roots == {x: i for i, j in near for x in (i, j)}
    monkeypatch.setattr(simhash_dedup, "majority", lambda *_: 0)  # all fingerprints are equal, the texts are not
    assert {r.node: r.root for r in near_copies.groups(rows).collect()}.get(1, 1) == 1
    assert simhash_dedup.near_pairs(rows).count() == len(texts) - 1
