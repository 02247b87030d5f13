"""Snippets: where query terms stand in the values of a result's sections, and a window around each.

Offsets come in bytes and in UTF-16 units; a window is measured in code points, ends at token borders,
takes trailing punctuation along and gives room that one side does not need to the other.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import normalize_term
from siftline.operators.schema import Section
from siftline.plans.query import _SEGMENT, Term

MATCHES = "array<struct<path:string,byte_pos:int,byte_len:int,utf16_pos:int,utf16_len:int,window:string,window_byte_pos:int,window_byte_len:int,window_utf16_pos:int,window_utf16_len:int>>"
FIELDS = ("path", "byte_pos", "byte_len", "utf16_pos", "utf16_len", "window", "window_byte_pos", "window_byte_len", "window_utf16_pos", "window_utf16_len")


def spans(text: str) -> list[tuple[int, int]]:
    """Token borders in code points; spaces and punctuation are not tokens."""
    return [m.span() for m in _SEGMENT.finditer(text) if not m.group().isspace() and not _punct(m.group()[0])]


def _punct(c: str) -> bool:
    return c in "!\"#%&'*,./:;?@\\_-([{}])" if c.isascii() else unicodedata.category(c)[0] == "P"


def utf16(s: str) -> int:
    return len(s) + sum(ord(c) > 0xFFFF for c in s)


def window(text: str, toks: list[tuple[int, int]], i: int, size: int) -> tuple[int, int]:
    """(start, end) of at most `size` code points of whole tokens around token i; empty if the token alone does not fit.

    Of spare room that is odd, one more code point goes before a match of odd length, or behind one of even length.
    """
    a, b = toks[i]
    if size < b - a or size <= 0:
        return a, a
    middle = a + (b - a) // 2
    below, most = middle - size // 2 - 1, middle + (size + 1) // 2
    lo = next(s for s, _ in toks if s > below)
    most += lo - 1 - below
    hi = max(e for _, e in toks if e <= most)
    while hi < min(len(text), most) and _punct(text[hi]):
        hi += 1
    if most > hi:
        lo = next(s for s, _ in toks if s > lo - 1 - (most - hi))
    return lo, hi


def find(values: list[tuple[str, str]], want: list[tuple[str, bool]], most: int, size: int) -> list[tuple]:
    """Matches in (path, value) pairs of one section; `want`: (term, prefix)."""
    out = []
    for path, text in values:
        toks = spans(text)
        for i, (a, b) in enumerate(toks):
            if len(out) >= most:
                return out
            t = normalize_term(text[a:b])
            if any(t == w or p and t.startswith(w) for w, p in want):
                head, word = text[:a], text[a:b]
                lo, hi = window(text, toks, i, size)
                before, seen = text[:lo], text[lo:hi]
                out.append((path, len(head.encode()), len(word.encode()), utf16(head), utf16(word), seen, len(before.encode()), len(seen.encode()), utf16(before), utf16(seen)))
    return out


def walk(props: dict | None, path: str) -> list[tuple[str, str]]:
    """(a[1].b[0], value) of a dotted path; an index is left out where a list has one value."""
    at = [("", props or {})]
    for name in path.split("."):
        step = []
        for p, node in at:
            vs = (node or {}).get(name)
            vs = [] if vs is None else list(vs)
            for i, v in enumerate(vs):
                here = f"{p}.{name}" if p else name
                step.append((f"{here}[{i}]" if len(vs) > 1 else here, v))
        at = step
    return [(p, v) for p, v in at if isinstance(v, str)]


def _plain(x):
    if hasattr(x, "asDict"):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x


def snippet(results: DataFrame, sections: list[Section], terms: list[Term], prefix: bool, num_to_snippet: int, per_property: int = 100, max_window: int = 160, root: str = "props") -> DataFrame:
    """Results (with `rank` over all pages) with `snippets`; only the first num_to_snippet get any. Runs on what projection left."""
    plan = [(s.schema, s.path, [(t.text, prefix and s.match == "prefix") for t in terms if t.path in (None, s.path)]) for s in sections]
    cols = results.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for kind, props, rank in zip(pdf["schema"], pdf[root], pdf["rank"]):
                got = []
                if rank <= num_to_snippet:
                    tree = _plain(props)
                    for name, path, want in plan:
                        if name == kind and want:
                            got += find(walk(tree, path), want, per_property, max_window)
                out.append([dict(zip(FIELDS, g)) for g in got])
            yield pdf[["doc_id"]].assign(snippets=out)

    made = results.select("doc_id", "schema", root, "rank").mapInPandas(run, f"doc_id long, snippets {MATCHES}")
    return results.join(made, "doc_id").select(*cols, F.col("snippets"))
