import numpy as np
from pyspark.sql import functions as F

from siftline.llm import mixing

MIX = {"low": 0.15, "high": 0.85}


def test_cover_drops_no_row_of_overlapping_domains(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(1500):
        low = i % 5 == 0
        marks = rng.binomial(40, 0.3 if low else 0.15)
        rows.append((i, " ".join(["abc&&&"] * marks + ["word"] * (40 - marks))))
        labels.append((i, int(not low), 0))
    docs = spark.createDataFrame([*rows, (None, "words"), (5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels, MIX, True).collect()
    assert sum(0.05 < r.p_low < 0.95 for r in got) > 100
    assert min(r.rate for r in got) >= 1 and min(r.copies for r in got) >= 1
    total = sum(r.tokens * r.rate for r in got)
    assert abs(sum(r.tokens * r.rate * r.p_low for r in got) - 0.15 * total) < 0.01 * total
    kept = mixing.resample(docs, labels, MIX)
    assert kept.select("doc_id", "text").distinct().count() == docs.distinct().count()


def test_cover_with_posteriors_too_soft_for_the_targets(spark):
    rated = spark.range(1000).select((F.col("id") % 90 + 10).alias("tokens"), F.array(F.lit(0.4) - F.col("id") % 7 / 100, F.lit(0.6) + F.col("id") % 7 / 100).alias("p"))
    rate = mixing._rate(F.col("p"), mixing.fit_rates(rated, [0.15, 0.85], True), True)
    r = rated.select(F.min(rate), F.sum(rate * F.col("tokens")) / F.sum("tokens")).first()
    assert r[0] >= 1 and r[1] < 4 / 0.15


def test_targets_that_cut_most_rates_settle_at_the_least_change(spark, monkeypatch):
    rng = np.random.default_rng(6)
    z = np.exp(rng.normal(size=(3000, 3)) * 2 + [0, 2.5, -1])
    p, tokens = z / z.sum(axis=1, keepdims=True), rng.integers(1, 400, 3000)
    rated = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, p array<double>").cache()
    passes = []
    first = type(rated).first
    monkeypatch.setattr(type(rated), "first", lambda df: passes.append(1) or first(df))
    targets = np.array([0.30, 0.69, 0.01])
    steps = mixing.fit_rates(rated, targets.tolist(), False)
    assert len(passes) <= 25
    rate = np.array([r[0] for r in rated.select(mixing._rate(F.col("p"), steps, False)).collect()])
    assert np.abs((tokens * rate) @ p / tokens.sum() - targets).max() < 2e-4
    # rates that change least are one less a combination of posteriors where they are not cut, and cut where that is negative
    some = rate > 0
    along = np.linalg.lstsq(p[some], 1 - rate[some], rcond=None)[0]
    assert np.abs(1 - p @ along - np.where(some, rate, np.minimum(0, 1 - p @ along))).max() < 1e-6 and (rate == 0).mean() > 0.1


def test_cover_settles_in_few_passes_where_growth_spills_over(spark, monkeypatch):
    rng = np.random.default_rng(0)
    high = 1 / (1 + np.exp(-rng.normal(size=4000) * 0.5 - 1.5))
    p, tokens = np.stack([1 - high, high], axis=1), rng.lognormal(5, 1, 4000).round().astype(int)
    rated = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, p array<double>").cache()
    passes = []
    first = type(rated).first
    monkeypatch.setattr(type(rated), "first", lambda df: passes.append(1) or first(df))
    steps = mixing.fit_rates(rated, [0.15, 0.85], True)
    rate = np.array([r[0] for r in rated.select(mixing._rate(F.col("p"), steps, True)).collect()])
    totals = (tokens * rate) @ p
    assert rate.min() >= 1 and np.abs(totals / totals.sum() - [0.15, 0.85]).max() < 2e-4
    assert len(passes) <= 12
