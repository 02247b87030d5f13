"""The written index: tokens once a text, counts inside a row, marks instead of sets of doc_ids."""

import random

import duckdb
from pyspark.sql import functions as F

from siftline import catalog
from siftline.functions import text as X
from siftline.operators import index
from siftline.sources import tables as S


def test_texts_are_tokenized_once(spark):
    made = index.section_tokens(S.documents(spark, "/root/testdata/sf0.001"), S.SECTIONS)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == len(S.SECTIONS)


def test_postings_are_counted_without_a_shuffle(spark):
    made = index.build_postings(index.section_tokens(S.documents(spark, "/root/testdata/sf0.001"), S.SECTIONS))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_counts_hold_no_sets_of_documents(spark):
    for name in ("lexicon_stats", "top_terms"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "doc_id" not in plan


def test_patterns_agree(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1_.:,;'’ $é٣́-😀𝐀") for _ in range(30)) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*(F.regexp_extract_all("t", F.lit(x), F.lit(0)).alias(n) for n, x in (("a", X.RX), ("b", X.JAVA_RX))))
    assert rows.where("a <> b").isEmpty()


def test_odd_documents(spark, tmp_path):
    """Ids that stand twice, in two namespaces or not at all; no text; more tokens than are indexed or counted."""
    rows = [(1, "the lantern the end", "src0"), (1, "the lantern", "src1"), (2, None, "src0"), (3, "", "src0"), (None, "lantern", "src0"), (4, "garden " * 300 + "the lantern", "src1"), (5, "w1 w2 " * 7000 + "lantern", None)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, 'en', ?, 7)", [list(r) for r in rows])
    c.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    c.execute("CREATE TABLE events AS SELECT * FROM (SELECT 1::BIGINT AS user_id, 'view' AS event_type, TIMESTAMP '2024-01-01' AS ts)")
    for name in ("lexicon_stats", "top_terms", "term_freq", "exact_term", "ns_filter"):
        df = catalog.queries()[name](spark, str(tmp_path))
        want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)), name
