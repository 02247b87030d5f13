"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = [
    "tokenize_vocab", "term_freq", "doc_length", "corpus_stats", "exact_term", "prefix_term", "and_terms", "and_four_terms", "or_four_terms", "nested_group", "section_restrict", "empty_query",
    "doc_score_rank", "recency_rank", "usage_count_rank", "bm25_single", "bm25_or", "bm25_restrict", "topk_page2", "group_limit", "delete_by_query", "upsert_latest", "usage_agg", "optimize_renumber",
    "storage_info", "suggest_prefix", "projection_nested", "snippet_offsets",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from siftline import catalog

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").count()
    took = {}
    for name in QUERIES:
        t = time.time()
        catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    took |= serve(spark, sf)
    print(json.dumps({"metric": "total_wall", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


def serve(spark, sf: str) -> dict[str, float]:
    """The same searches over a written, term-sorted postings table: what a running index costs a query."""
    import uuid

    from siftline.operators import index, rank, score, store
    from siftline.plans import match, query
    from siftline.sources import tables
    from siftline.sources.shared import shared_dir

    out, at = {}, f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    t = time.time()
    made = index.section_tokens(tables.documents(spark, sf), tables.SECTIONS)
    index.write_postings(index.build_postings(made), f"{at}/postings", 8)
    out["index_build"] = round(time.time() - t, 3)
    posts = spark.read.parquet(f"{at}/postings")
    docs = store.doc_filter(tables.documents(spark, sf), tables.NOW_MS).withColumnRenamed("score", "score_input").select("doc_id", "namespace", "schema", "score_input", "creation_ts_ms")
    for name, q in (("served_and", "the of"), ("served_or", "the OR der"), ("served_not", "the -was"), ("served_rare", "anreti")):
        t = time.time()
        m = match.match(posts, docs, query.parse(q)).withColumn("score", score.simple("document_score", "desc"))
        rank.page(m).write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - t, 3)
    return out


if __name__ == "__main__":
    main()
