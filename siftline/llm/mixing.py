"""Mixing to target weights with soft membership, in DataFrame functions only.

A softmax classifier, fitted on a bounded draw of labelled rows, predicts for every document how likely it
is of each domain (low, high, toxic, by the labels table). Nonnegative rates per document are then
fitted by projected gradient steps so that the expected token totals of the domains match the targets in
least squares: each step is one aggregation over all documents of rate x tokens x posterior, and moves
every rate against the misfit, in the metric of the second moments of the tokens whose rates are not cut. Rates are
what the sum of the steps makes of one, cut at zero (at one, to cover), so no state is kept between passes, and of all rates
that meet the targets they are those that change least.

Bounds, parameters: `per_class` labelled rows a domain for the fit; everything else reads all rows.

Defined results: null and empty texts have no tokens and get the rate of their posteriors; a null doc_id
is fine; documents without label are predicted like all; without labels posteriors are even; targets of
an absent domain leave a misfit, as do targets that posteriors are too soft to reach with rates of one or more; repeated rows are rated each; an empty table gives no row; extra columns
are kept by resample().
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_columns, text_or_empty

DOMAINS = ("low", "high", "toxic")
TARGETS = {"low": 0.10, "high": 0.85, "toxic": 0.05}
BUCKETS = 4096
SHAPE = ("symbols", "digits", "capitals", "letters_a_word", "line_share", "log_length", "marks")


def _shape(t: Column) -> list[Column]:
    n = F.greatest(F.char_length(t), F.lit(1)).cast("double")
    words = F.greatest(F.regexp_count(t, F.lit(r"\S+")), F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    return [
        F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]")) / n * 10, F.regexp_count(t, F.lit("[0-9]")) / n * 10, F.regexp_count(t, F.lit(r"\p{Lu}")) / n * 10,
        n / words / 8, F.size(F.array_distinct(lines)) / F.size(lines), F.log(n) / 8, F.least(F.regexp_count(t, F.lit(r"[#$%&*@!]{2,}")) / words * 4, F.lit(4.0)),
    ]


def _buckets(t: Column) -> Column:
    return F.transform(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def domain_of(domains: tuple[str, ...]) -> Column:
    """The labelled table's domain number: toxic before quality."""
    at = {d: i for i, d in enumerate(domains)}
    quality = F.when(F.col("quality") == 1, at["high"]).when(F.col("quality") == 0, at["low"])
    return F.when(F.col("toxic") == 1, at["toxic"]).otherwise(quality) if "toxic" in at else quality


def softmax_fit(x: np.ndarray, y: np.ndarray, k: int, decay: float = 1e-3, rounds: int = 500) -> np.ndarray:
    one = np.eye(k)[y]
    w = v = np.zeros((x.shape[1], k))
    rate = 2 / max(1e-9, (x**2).sum(axis=1).mean())
    for i in range(rounds):
        z = x @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = v - rate * (x.T @ (p - one) / len(x) + decay * v)
        v, w = new + i / (i + 3) * (new - w), new
    return w


def posteriors(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS, per_class: int = 1500) -> tuple[Column, Callable[[str], Column]]:
    """(features of the column `text`, and from the column that holds them each domain's logit)."""
    rows = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(domain_of(domains)).alias("y")).where("y IS NOT NULL")
    few = None
    for d in range(len(domains)):
        one = rows.where(F.col("y") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        few = one if few is None else few.unionByName(one)
    t = text_or_empty()
    # the draw has at most per_class x domains rows of 12 bytes; a doc_id may stand for any number of rows
    held = docs.select("doc_id", t.alias("text")).join(F.broadcast(few), "doc_id").select("text", "y")
    sample = None
    for d in range(len(domains)):
        one = held.where(F.col("y") == d).orderBy(F.xxhash64("text"), "text").limit(per_class)
        sample = one if sample is None else sample.unionByName(one)
    sample = materialize(sample, "mix-sample")
    n = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    if len(n) < 2:
        return F.array(F.lit(0.0)), lambda x: F.array(*[F.lit(0.0)] * len(domains))
    weights = None
    if "toxic" in domains:
        hit = F.when(F.col("y") == domains.index("toxic"), 1).otherwise(0)
        seen = sample.select(hit.alias("y"), F.explode(F.array_distinct(_buckets(F.col("text")))).alias("b")).groupBy("b").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
        share = n.get(domains.index("toxic"), 0) / sum(n.values())
        weights = [0.0] * BUCKETS
        for r in seen:
            p, q, e = r["p"], r["n"] - r["p"], r["n"] * share
            gain = 2 * (p * math.log(p / e) if p and e else 0.0) + 2 * (q * math.log(q / (r["n"] - e)) if q and r["n"] > e else 0.0)
            if gain > 12 and p > e:
                weights[r["b"]] = min(6.0, math.log((p + 0.5) / (e + 0.5)))

    def features(text: Column) -> list[Column]:
        out = _shape(text)
        if weights:
            w = F.array(*map(F.lit, weights))
            total = F.aggregate(_buckets(text), F.lit(0.0), lambda a, b: a + F.element_at(w, b + 1))
            out += [F.log1p(total), F.when(total > 0, 1.0).otherwise(0.0)]
        return [x.cast("double") for x in out]

    got = sample.select("y", F.array(*features(F.col("text"))).alias("x")).collect()  # the bounded draw
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = softmax_fit(np.hstack([(x - mean) / sd, np.ones((len(x), 1))]), y, len(domains))
    true = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    flat = w[:-1] / sd[:, None]
    const = w[-1] - mean @ flat + np.array([math.log(true.get(d, 0) + 0.5) - math.log(n.get(d, 0) + 0.5) for d in range(len(domains))])
    logits = lambda x: F.array(*[sum((F.col(x)[i] * F.lit(float(flat[i, d])) for i in range(len(flat))), F.lit(float(const[d]))) for d in range(len(domains))])
    return F.array(*features(t)), logits


def _rate(p: Column, steps: list[list[float]], cover: bool) -> Column:
    """One less the summed steps along p, cut at zero (at one, to cover)."""
    least = F.lit(1.0 if cover else 0.0)
    return F.greatest(least, F.lit(1.0) - sum(p[d] * F.lit(float(x)) for d, x in enumerate(map(sum, zip(*steps))))) if steps else F.lit(1.0)


def fit_rates(rated: DataFrame, targets: list[float], cover: bool, rounds: int = 200, close: float = 1e-4, most: float = 4.0, soft: float = 1e-7) -> list[list[float]]:
    """The steps whose sum gives each document's rate. `rated`: tokens, p.

    Steps end when the targets are met or, where rates cannot meet them, at the least squares, found where the
    gradient of the misfit and of `soft` times the change of rates vanishes. Both make one convex function of the summed
    steps, which no step may raise, so a few steps settle it. Not to settle in `rounds` is an error.

    With `cover` targets are shares of whatever total rates of one or more make, so steps lie across the targets; totals
    grow to `most` times what lets no domain shrink, at most. Where no growth comes nearer to the targets, rates stay at one.
    """
    k = len(targets)
    low = 1.0 if cover else 0.0
    of = [(d, e) for d in range(k) for e in range(d, k)]

    def measure(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, second moments of the rows that are not cut, and the integral of the rates along the steps; one pass."""
        rate, t = _rate(F.col("p"), steps, cover), F.col("tokens").cast("double")
        free = F.lit(1.0) - sum((F.col("p")[d] * F.lit(float(x)) for d, x in enumerate(map(sum, zip(*steps)))), F.lit(0.0))
        slim = rated.select(*[F.col("p")[d].alias(f"p{d}") for d in range(k)], (t * rate).alias("mass"), F.when(free >= low, t).otherwise(0.0).alias("moves"), (t * F.when(free >= low, free * free / 2).otherwise(low * (free - low / 2))).alias("area"))
        row = slim.agg(*[F.sum(F.col("mass") * F.col(f"p{d}")) for d in range(k)], *[F.sum(F.col("moves") * F.col(f"p{d}") * F.col(f"p{e}")) for d, e in of], F.sum("area")).first()
        got = [float(x or 0) for x in row]
        moment = np.zeros((k, k))
        for (d, e), x in zip(of, got[k:]):
            moment[d, e] = moment[e, d] = x
        return np.array(got[:k]), moment, got[-1]

    have, moment, area = measure([])
    total = have.sum()
    if total <= 0:
        return []
    have, moment, area = have / total, moment / total, area / total
    w = np.array(targets) / sum(targets)
    start = max(h / x for h, x in zip(have, w) if x > 0)
    across = np.linalg.svd(w[None])[2][1:] if cover else np.eye(k)
    steps: list[list[float]] = []
    at = np.zeros(k)
    for _ in range(rounds):
        want = w * (have.sum() if cover else 1.0)
        slope = across.T @ (across @ (soft * at + want - have))
        if np.abs(have - want).max() <= close or np.abs(slope).max() <= 0.1 * close:
            break
        step = -across.T @ np.linalg.solve(across @ moment @ across.T + soft * np.eye(len(across)), across @ slope)
        worth = soft / 2 * at @ at + want @ at + area
        while True:
            new, new_moment, new_area = (x / total for x in measure([*steps, step.tolist()]))
            to = at + step
            if soft / 2 * to @ to + want @ to + new_area <= worth + 1e-4 * slope @ step + 1e-12 * (1 + abs(worth)):
                break
            step = step / 4  # the function is convex, so a short step does not raise it
        was = have.sum()
        at, have, moment, area = to, new, new_moment, new_area
        steps.append(step.tolist())
        if cover and have.sum() > most * start:  # totals are convex in a step: this part of it stays within
            part_of = max(0.0, (most * start - was) / (have.sum() - was))
            steps[-1] = [x * part_of for x in steps[-1]]
            warnings.warn("targets out of reach: totals end where they grow too far", stacklevel=2)
            return steps
    else:
        raise RuntimeError(f"rates did not settle in {rounds} steps")
    if (misfit := float(np.abs(have - want).max())) > close:
        warnings.warn(f"targets out of reach: misfit {misfit:.4f} of all tokens", stacklevel=2)
    return steps


def _measured(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], keep: Column) -> DataFrame:
    """kept, tokens, p and u, a number from 0 to 1 that is the row's own (drawn once and written, so that repeated rows round apart)."""
    x, logits = posteriors(docs, labels, domains)
    t = text_or_empty()
    u = F.pmod(F.xxhash64("doc_id", t, F.monotonically_increasing_id()), F.lit(1 << 20)) / F.lit(float(1 << 20))
    slim = docs.select(keep.alias("kept"), F.regexp_count(t, F.lit(r"\S+")).cast("long").alias("tokens"), x.alias("_x"), u.alias("u"))
    # one step at a time: what is used more than once is computed once
    slim = slim.withColumn("_z", logits("_x")).withColumn("_top", F.array_max("_z"))
    slim = slim.withColumn("_e", F.transform("_z", lambda a: F.exp(a - F.col("_top")))).withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))
    return materialize(slim.withColumn("p", F.transform("_e", lambda a: a / F.col("_sum"))).drop("_x", "_z", "_top", "_e", "_sum"), "mix")


def _copies(rate: Column) -> Column:
    return F.floor(rate + F.col("u")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, cover: bool = False) -> DataFrame:
    """doc_id, tokens, a posterior for each domain, rate, copies (the rate rounded by a hash of the row)."""
    targets = targets or TARGETS
    domains = tuple(d for d in DOMAINS if d in targets)
    rated = _measured(docs, labels, domains, F.col("doc_id")).withColumnRenamed("kept", "doc_id")
    rate = _rate(F.col("p"), fit_rates(rated, [targets[d] for d in domains], cover), cover)
    out = rated.withColumn("rate", rate)
    return out.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate", _copies(F.col("rate")).alias("copies"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float], cover: bool = True) -> DataFrame:
    """The rows, each as often as its copies. With `cover` no rate is below one, so every row stays."""
    domains = tuple(d for d in DOMAINS if d in targets)
    rated = _measured(docs, labels, domains, F.struct(*own_columns(docs)))  # one struct: no name of a column can clash
    rate = _rate(F.col("p"), fit_rates(rated.select("tokens", "p"), [targets[d] for d in domains], cover), cover)
    many = rated.select("kept", _copies(rate).alias("n")).where("n > 0").select("kept", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return many.select("kept.*")
