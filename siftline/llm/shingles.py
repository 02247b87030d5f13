"""Word shingle hashes and bit votes, vectorised per document."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash


def ascii_words(text: str) -> list[bytes]:
    """A-Z lower-cased; words are runs without space, tab, line feed, vertical tab, form feed or return."""
    return text.encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of k space-joined words, repeats included; fewer words: the whole sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, seed)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - k]]
    return np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(words) - k + 1)


def bit_sums(hashes: np.ndarray, weights: np.ndarray | None = None, step: int = 8192) -> np.ndarray:
    """How much weight sets each of the 64 bits, lowest bit first."""
    total = np.zeros(64)
    for at in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[at : at + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[at : at + step] @ bits
    return total


def pack_bits(on: np.ndarray) -> int:
    return int(np.packbits(on.astype(np.uint8), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
