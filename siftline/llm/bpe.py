"""Exact, cached encoding with the tokenizers library.

Text is cut where the tokenizer's own pre-tokenizer always cuts (before a single space that a
visible character follows), so equal chunks give equal ids wherever they stand. Each distinct
chunk is encoded once per worker and then reused; the ids equal those of encoding the whole text.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

_SIGNS = "!-/:-@\\[-`{-~"
_LETTERS = "".join(c for c in map(chr, range(0x21, 0x130)) if c.isalpha())
#: Line end, letters, ASCII signs up to the chunk's end: any pre-tokenizer here cuts letters from the run of signs behind them.
_WORD = re.compile(f"(\n?)([{_LETTERS}]+)([{_SIGNS}]*)")
#: In a text with any of these a space or line end may go with what stands before it.
_LOOSE = ("  ", " \n", "\n ", "\n\n", "\0", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
_U4 = np.dtype("<u4")
_BULK = 250


class ChunkEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes. `limit`: chunks kept per worker."""

    def __init__(self, path: str, limit: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # such strings in a text are ordinary text
        self.limit = limit
        probe = self.tok.encode("a\na", add_special_tokens=False).tokens
        self.words = not any("Ċ" in t for t in probe)
        self.lead = "" if self.words else " "
        self.newline = None if self.words else self._ids("\n")[0]
        vocab = self.tok.get_vocab()
        self.edges = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a word, or begin one after a space
        for t, i in vocab.items():
            self.edges[i] = t.endswith("</w>") if self.words else t.startswith("Ġ")
        self.newline_bytes = np.array([self.newline or 0], dtype=_U4).tobytes()
        self.chunks: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=_U4).tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _bulk(self, some: list[str], lead: str) -> list[bytes]:
        """ids of many words by one call; an id that ends or begins each of them tells where to cut."""
        gap = 0
        if self.words:
            ids = np.array(self._ids(" ".join(some)), dtype=_U4)
            cuts = [0, *((np.flatnonzero(self.edges[ids]) + 1) * 4).tolist()]
        elif lead:
            ids = np.array(self._ids(lead + lead.join(some)), dtype=_U4)
            cuts = [*(np.flatnonzero(self.edges[ids]) * 4).tolist(), len(ids) * 4]
        else:
            ids = np.array(self._ids("\n".join(some)), dtype=_U4)
            cuts = [-4, *(np.flatnonzero(ids == self.newline) * 4).tolist(), len(ids) * 4]
            gap = 4
        if len(cuts) != len(some) + 1:
            return self._alone([lead + c for c in some])
        data = ids.tobytes()
        return [data[a + gap : b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, new: list[str]) -> None:
        """Letters and the signs that close them are always cut apart, so words are encoded without them."""
        known, stems, made, rest = self.chunks, ({}, {}), [], []
        match = _WORD.fullmatch
        for c in new:
            m = match(c)
            if m is None:
                rest.append(c)
                continue
            nl, stem, tail = m.groups()
            key = nl + stem
            if key not in known:
                stems[bool(nl)][stem] = None
            if tail:
                made.append((c, key, tail))
        for nl in (False, True):
            todo = list(stems[nl])
            for at in range(0, len(todo), _BULK):
                some = todo[at : at + _BULK]
                got = self._bulk(some, "" if nl else self.lead)
                known.update(zip(("\n" + x for x in some), (self.newline_bytes + x for x in got)) if nl else zip(some, got))
        tails = self.tails
        unseen = list({t for _, _, t in made}.difference(tails))
        tails.update(zip(unseen, self._alone(unseen)))
        for c, key, tail in made:
            known[c] = known[key] + tails[tail]
        for at in range(0, len(rest), 1000):
            some = rest[at : at + 1000]
            known.update(zip(some, self._alone([c if c[:1] in ("\n", "") else self.lead + c for c in some])))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > self.limit:  # the oldest chunks are the frequent ones
            self.chunks = dict(islice(self.chunks.items(), self.limit // 2))
        if len(self.tails) > self.limit:
            self.tails = {"": b""}
        out, whole, spans, firsts, flat = [b""] * len(texts), [], [], [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.words:
                parts = t.replace("\n", " ").split(" ")
            elif t[-1] == " " or any(map(t.__contains__, _LOOSE)):
                whole.append(i)
                continue
            else:
                parts = t.replace("\n", " \n").split(" ")
                firsts.append(parts[0])  # no space before it
                parts[0] = ""
            spans.append((i, len(flat), len(flat) + len(parts)))
            flat += parts
        got = list(map(self.chunks.get, flat))
        unknown = [j for j, x in enumerate(got) if x is None]
        if unknown:
            self._learn(list(dict.fromkeys(flat[j] for j in unknown)))
            for j in unknown:
                got[j] = self.chunks[flat[j]]
        if firsts:
            for (_, a, _), x in zip(spans, self._alone(firsts)):
                got[a] = x
        for i, a, b in spans:
            out[i] = b"".join(got[a:b])
        for i, x in zip(whole, self._alone([texts[i] for i in whole])):
            out[i] = x
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process, so its chunks serve all of that worker's tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
