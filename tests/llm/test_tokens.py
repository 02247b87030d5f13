import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftline.llm import bpe, packing, token_files


def ids_of(name, text):
    t = Tokenizer.from_file(bpe.public_path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name):
    rng = np.random.default_rng(1)
    odd = ["", " ", "a\n\n b", "x　y", "<|endoftext|> hi", "İstanbul Σας", "don't DON'T", "a \n b\t\tc", "日本 語", " ́x", "a " * 5, "\n", "\nab.\ncd", "a.\n\nb"]
    odd += ["".join(rng.choice(list("ab ,.'\n\t1́\xa0é日\x1c-_sS"), rng.integers(1, 40))) for _ in range(400)]
    enc = bpe.ChunkEncoder(bpe.public_path(name), limit=50)
    for at in range(0, len(odd), 40):
        some = odd[at : at + 40]
        for t, x in zip(some, enc.encode(some)):
            assert np.frombuffer(x, "<u4").tolist() == ids_of(name, t), repr(t)


@pytest.mark.parametrize("high", [2, 300, 1 << 16, 1 << 40, 1 << 63])
def test_words_round_trip(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 59, 1024, 5000):
        ids = rng.integers(0, high, n, dtype=np.uint64) >> rng.integers(0, 20, n, dtype=np.uint64)
        if n and high > 1 << 60:
            ids[::7] |= np.uint64(1 << 61)
        words, offsets, escapes = token_files.pack_words(ids)
        assert (token_files.unpack_words(words, n, offsets.astype(np.int64) if escapes else None) == ids).all()
        data = token_files.write_segment([None], [n], ids)
        for b in range(len(offsets) - 1):
            assert (token_files.read_block(data, b) == ids[1024 * b : 1024 * (b + 1)]).all()


def test_files_give_back_every_id(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    want, start = {}, 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of("byte_bpe_50k.json", r[1]), 2]
        want.setdefault(r[0], []).append((start, len(ids), crc(ids)))
        start += len(ids)
    got = {}
    for r in token_files.token_digest(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_files.token_digest(empty).count() == 0


def test_a_small_table_makes_few_parts(spark, docs, monkeypatch):
    """Each file costs its executor a fork; a part holds PART_BYTES of text, however many partitions are set."""
    want = sorted(map(str, token_files.token_digest(docs).drop("part", "seg").collect()))
    size = sum(len((r["text"] or "").encode()) for r in docs.select("text").collect())
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for least, parts in ((1 << 22, 1), (size // 3, 4)):
            monkeypatch.setattr(token_files, "PART_BYTES", least, raising=False)
            got = token_files.token_digest(docs).cache()
            assert 1 <= got.select("part").distinct().count() <= parts
            assert sorted(map(str, got.drop("part", "seg").collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_packing_is_whole_and_tight(docs, empty):
    got = packing.pack(docs, seq_len=256).collect()
    per_seq = {}
    for r in got:
        per_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in per_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    want = sorted((r[0] is None, r[0] or 0, s, crc(ids[s : s + 256]), len(ids)) for r in docs.select("doc_id", "text").collect() for ids in [[*ids_of("word_bpe_49k.json", r[1]), 1]] for s in range(0, len(ids), 256))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.ids_crc32, r.doc_tokens) for r in got) == want
    total = sum(r.length for r in got)
    assert len(per_seq) <= 1.1 * total / 256 + 2
    assert packing.pack(empty).count() == 0


def test_layout_meets_demand_near_the_bound():
    rng = np.random.default_rng(2)
    for n in (5, 300, 20_000):
        demand = np.bincount(rng.integers(0, 64, n), minlength=64)
        plan = packing.layout(demand, 64)
        assert (sum(p * k for p, k in plan) == demand).all()
        assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in plan)
        assert sum(k for _, k in plan) <= 1.03 * (demand * np.arange(1, 65)).sum() / 64 + 12


def test_a_batch_takes_few_calls_of_the_tokenizer():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = [" ".join(word() + str(rng.choice(["$$$", "),", "-x1", "42", "é.", '."'])) for _ in range(20)) for _ in range(100)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc, calls = bpe.ChunkEncoder(bpe.public_path(name)), []
        real = enc.tok
        whole = [x.ids for x in real.encode_batch_fast(texts, add_special_tokens=False)]

        class Counted:
            def encode_batch_fast(self, some, **named):
                calls.append(len(some))
                return real.encode_batch_fast(some, **named)

        enc.tok = Counted()
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == whole
        assert len(calls) <= 20


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_sign_behind_a_word_is_not_taken_for_a_chunk(name):
    enc = bpe.ChunkEncoder(bpe.public_path(name))
    for t in ("ab. cd, ef", "\0.", "x \0, y", "\0"):
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == ids_of(name, t)
