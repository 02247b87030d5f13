"""Toxicity by weak supervision.

Voters are lexicons of words and patterns (word beginnings) whose presence separates the labelled
classes, and three style rules. A generative label model (one reliability a voter and class, fitted by
EM; votes that go together beyond what the classes explain share their weight) gives posterior labels,
on which a linear classifier over the single words and patterns is trained.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0; the score reads nothing
but the text. Bound, a parameter: at most `per_class` labelled rows of either class are drawn by hash.

Defined results: null text is the empty text and gets the constant's score; null doc_id is scored, never
learned from and not held out; several labels of a row count as toxic if one is; repeated rows are
scored each; without labelled rows of both classes every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, text_or_empty

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
STYLE = ("!", "?!", "caps")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def held_terms(text: str) -> list[str]:
    """The terms of a text; those that stand more than once also with a plus sign."""
    n: Counter = Counter()
    for w, k in Counter(WORD.findall(text.lower())).items():
        for t in terms(w):
            n[t] += k
    return [*n, *(t + "+" for t, k in n.items() if k > 1)]


def style(text: str) -> list[float]:
    n = max(1, len(text))
    shout = sum(1 for w in re.findall(r"[A-Z]{3,}", text) if len(w) < 20)
    return [float(text.count("!") * 200 > n), float("?!" in text or "!!" in text), float(shout * 100 > n)]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = (Counter(), Counter())
    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen[y].update(held_terms(t))
    keys = [k for k in seen[1]]
    yield pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "pos": pa.array([seen[1][k] for k in keys], pa.int64()), "neg": pa.array([seen[0][k] for k in keys], pa.int64())})
    rest = [k for k in seen[0] if k not in seen[1]]
    yield pa.RecordBatch.from_pydict({"term": pa.array(rest, pa.string()), "pos": pa.array([0] * len(rest), pa.int64()), "neg": pa.array([seen[0][k] for k in rest], pa.int64())})


class Reader:
    """Which of the chosen terms a text holds; what a word holds is remembered."""

    def __init__(self, chosen: list[str], limit: int = 300_000):
        self.at, self.memo, self.limit = {t: i for i, t in enumerate(chosen)}, {}, limit
        self.plain = {t.rstrip("+") for t in chosen}

    def __call__(self, text: str) -> set[int]:
        memo, n = self.memo, {}
        if len(memo) > self.limit:
            memo.clear()
        for w, k in Counter(WORD.findall(text.lower())).items():
            got = memo.get(w)
            if got is None:
                got = memo[w] = tuple(t for t in terms(w) if t in self.plain)
            for t in got:
                n[t] = n.get(t, 0) + k
        at = self.at
        return {at[x] for t, k in n.items() for x in ((t, t + "+") if k > 1 else (t,)) if x in at}


def label_model(votes: np.ndarray, prior: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Posterior of the positive class for rows of 0/1 votes."""
    y = np.where(votes.any(axis=1), 0.9, 0.1)
    for _ in range(rounds):
        a = (y @ votes + 1) / (y.sum() + 2)
        b = ((1 - y) @ votes + 0.5) / ((1 - y).sum() + 1)
        # correlations within the classes: a voter shares its weight with those it goes along with
        r = votes - (y[:, None] * a + (1 - y)[:, None] * b)
        s = np.sqrt((r**2).mean(axis=0)) + 1e-6
        c = np.abs((r.T @ r) / len(r) / np.outer(s, s))
        np.fill_diagonal(c, 1)
        w = 1 / np.maximum(1, np.where(c > 0.1, c, 0).sum(axis=1))
        z = np.log(prior / (1 - prior)) + votes @ (w * np.log(a / b)) + (1 - votes) @ (w * np.log((1 - a) / (1 - b)))
        y = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return y


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 3e-4, rounds: int = 400) -> np.ndarray:
    """Weights and constant by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = v = np.zeros(x.shape[1])
    rate = 4 / max(1e-9, (x**2).sum(axis=1).mean())
    for k in range(rounds):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ v, -30, 30))) - y) / len(x) + decay * v
        g[-1] -= decay * v[-1]
        new = v - rate * g
        v, w = new + k / (k + 3) * (new - w), new
    return w


def bounded(held: DataFrame, per_class: int, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(text, y): at most per_class rows a class, though a doc_id may stand for any number of rows."""
    parts = [held.where(F.col("y") == y).orderBy(F.xxhash64("text"), "text").limit(per_class) for y in classes]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_terms: int = 800, voters: int = 12, least_ratio: float = 16.0) -> tuple[list[str], np.ndarray] | None:
    """(terms, weights of terms, style rules and constant)."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")).where("y IN (0, 1)")
    share = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if len(share) < 2:
        return None
    drawn = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    few = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 x per_class rows of 12 bytes
    held = docs.select("doc_id", text_or_empty().alias("text")).join(few, "doc_id").select("text", "y")
    sample = materialize(bounded(held, per_class), "toxic-sample")
    size = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    if len(size) < 2:
        return None
    n1, n0 = size[1], size[0]
    counted = sample.mapInArrow(_count_terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    p, n, t = F.col("p"), F.col("n"), F.col("p") + F.col("n")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    ratio = 2 * (part(p, t * (n1 / (n1 + n0))) + part(n, t * (n0 / (n1 + n0))))
    best = counted.withColumn("g", ratio).where((p / n1 > 3 * (n + 0.5) / n0) & (F.col("g") > least_ratio)).orderBy(F.desc("g"), "term").limit(most_terms)
    chosen = [r["term"] for r in best.collect()]
    read = Reader(chosen)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([sorted(read(x)) for x in texts], pa.list_(pa.int32())), pa.array([style(x) for x in texts], pa.list_(pa.float64()))], names=["hits", "style"])

    got = sample.mapInArrow(look, "hits array<int>, style array<double>").collect()  # the bounded sample
    x = np.zeros((len(got), len(chosen) + len(STYLE)))
    for i, r in enumerate(got):
        x[i, r["hits"]] = 1
        x[i, len(chosen) :] = r["style"]
    lexicon = [[i for i, c in enumerate(chosen) if c[0] != "^"][k::voters] for k in range(voters)]
    pattern = [[i for i, c in enumerate(chosen) if c[0] == "^"][k::voters] for k in range(voters)]
    groups = [g for g in lexicon + pattern if g]
    votes = np.column_stack([*(x[:, g].max(axis=1) for g in groups), x[:, len(chosen) :]]) if len(got) else np.zeros((0, 1))
    votes = votes[:, votes.mean(axis=0) > 0] if votes.any() else votes[:, :1]
    w = logistic(x, label_model(votes, n1 / (n1 + n0)))
    true = share[1] / (share[0] + share[1])
    w[-1] += np.log(true / (1 - true)) - np.log(n1 / n0)  # the draw's class shares back to the labels'
    return chosen, w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = train(docs, labels, **options)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return with_scores(slim, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def with_scores(docs: DataFrame, model: tuple[list[str], np.ndarray] | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with a further column of their scores, whose `name` must be free."""
    ship(docs.sparkSession)
    chosen, w = model or ([], np.array([0.0, 0.0, 0.0, -np.inf]))
    read, weights, n = Reader(chosen), w.tolist(), len(chosen)
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                t = t or ""
                z = weights[-1] + sum(weights[i] for i in read(t)) + sum(a * x for a, x in zip(weights[n:], style(t)))
                out.append(1 / (1 + np.exp(-z)) if z > -700 else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], schema=pa.schema([*b.schema, pa.field(name, pa.float64())]))

    from pyspark.sql import types as T

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
