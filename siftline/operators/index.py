"""Postings, lengths and corpus statistics from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators.schema import Section, path_values
from siftline.plans.match import TF_CAP


def section_tokens(docs: DataFrame, secs: list[Section], normalizer: str = "latin") -> DataFrame:
    """doc_id, namespace, schema, section_id, path, in_prefix_section, terms, before (tokens of earlier sections): one row a section with values; one scan."""

    def one(s: Section):
        words = F.flatten(F.transform(path_values(s.path), lambda v: X.terms(v, normalizer, s.tokenizer)))
        made = F.struct(F.lit(s.section_id).alias("section_id"), F.lit(s.path).alias("path"), F.lit(s.match == "prefix").alias("in_prefix_section"), words.alias("terms"))
        return made if s.schema == "*" else F.when(F.col("schema") == s.schema, made)

    if not secs:
        return docs.sparkSession.createDataFrame([], "doc_id long, namespace string, schema string, section_id int, path string, in_prefix_section boolean, terms array<string>, before int")
    made = docs.select("doc_id", "namespace", "schema", F.array_sort(F.filter(F.array(*map(one, secs)), lambda x: x.isNotNull())).alias("_s"))
    sizes = made.withColumn("_n", F.transform("_s", lambda x: F.size(x["terms"])))
    # outer: the filter that Spark derives from an inner one would tokenize every text again, once a condition
    rows = sizes.select("doc_id", "namespace", "schema", "_n", F.posexplode_outer("_s").alias("_i", "s")).where(F.size("s.terms") > 0)
    before = F.aggregate(F.slice("_n", F.lit(1), F.col("_i")), F.lit(0), lambda a, b: a + b)
    return rows.select("doc_id", "namespace", "schema", "s.*", before.alias("before"))


def build_postings(sectioned: DataFrame, max_tokens: int = X.MAX_TOKENS, tf_cap: int = TF_CAP) -> DataFrame:
    """term, doc_id, section_id, path, tf, in_prefix_section, namespace, schema; tokens past the cap, in section order, are not indexed.

    Terms are counted inside their row (runs of the sorted terms): nothing is shuffled and no task holds more than a row.
    """
    room = F.greatest(F.lit(max_tokens) - F.col("before"), F.lit(0)).cast("int")
    keys = ("doc_id", "section_id", "path", "in_prefix_section", "namespace", "schema")
    rows = sectioned.select(*keys, F.sort_array(F.slice("terms", F.lit(1), room)).alias("_t")).where(F.size("_t") > 0)
    starts = F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: (i == 1) | (F.get("_t", i - 1) != F.get("_t", i - 2)))
    rows = rows.withColumn("_at", starts)
    end = lambda k: F.coalesce(F.get("_at", k + 1), F.size("_t") + 1)
    runs = F.transform("_at", lambda i, k: F.struct(F.get("_t", i - 1).alias("term"), F.least(end(k) - i, F.lit(tf_cap)).alias("tf")))
    return rows.select(*keys, F.inline_outer(runs))


def merge_repeated(postings: DataFrame, tf_cap: int = TF_CAP) -> DataFrame:
    """One row for what several documents with one doc_id hold alike."""
    return postings.groupBy(*[c for c in postings.columns if c != "tf"]).agg(F.least(F.sum("tf"), F.lit(tf_cap)).cast("int").alias("tf"))


def doc_lengths(docs: DataFrame, sectioned: DataFrame) -> DataFrame:
    """doc_id, namespace, schema, dl: all tokens of all sections, not capped; documents without tokens have 0."""
    sizes = sectioned.groupBy("doc_id").agg(F.sum(F.size("terms")).cast("long").alias("dl"))
    return docs.select("doc_id", "namespace", "schema").join(sizes, "doc_id", "left").withColumn("dl", F.coalesce("dl", F.lit(0).cast("long")))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """namespace, schema, n_docs, sum_len (saturating at a signed 32-bit integer), avgdl = sum_len / (1 + n_docs)."""
    out = lengths.groupBy("namespace", "schema").agg(F.count("*").alias("n_docs"), F.least(F.sum("dl"), F.lit(2**31 - 1)).alias("sum_len"))
    return out.withColumn("avgdl", F.col("sum_len") / (1 + F.col("n_docs")))


def merge_postings(base: DataFrame, delta: DataFrame, max_doc_id: int | None = None) -> DataFrame:
    """Compaction: a delta's documents replace their rows of the base; `max_doc_id` drops what is newer."""
    kept = base.join(delta.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(delta)
    return kept if max_doc_id is None else kept.where(F.col("doc_id") <= max_doc_id)


def write_postings(postings: DataFrame, path: str, n: int, marks: bool = False) -> None:
    """Sorted by term, so exact and prefix conditions skip files and row groups; a word of every document is cut by doc_id.

    marks: of a term's rows with one doc_id, first_of_doc is true for one, first_of_namespace for one a namespace (none without doc_id).
    """
    order = ["namespace", "section_id", "path", "in_prefix_section", "schema"] if marks else []
    laid = postings.repartitionByRange(n, "term", "doc_id").sortWithinPartitions("term", "doc_id", *order)
    if marks:
        # range and order are what the window asks for, so it neither shuffles nor sorts
        w = Window.partitionBy("term", "doc_id").orderBy(*order)
        laid = laid.withColumns({"_k": F.row_number().over(w), "_ns": F.lag("namespace").over(w)})
        first = F.col("_k") == 1
        laid = laid.withColumns({"first_of_doc": first & F.col("doc_id").isNotNull(), "first_of_namespace": (first | ~F.col("_ns").eqNullSafe(F.col("namespace"))) & F.col("doc_id").isNotNull()}).drop("_k", "_ns")
    laid.write.mode("overwrite").parquet(path)


def lexicon(postings: DataFrame) -> DataFrame:
    """term, docs, has_prefix_hits: the distinct terms. Marked postings are counted without a set of doc_ids."""
    docs = F.count_if("first_of_doc") if "first_of_doc" in postings.columns else F.countDistinct("doc_id")
    return postings.groupBy("term").agg(docs.alias("docs"), F.max("in_prefix_section").alias("has_prefix_hits"))


def suggest(postings: DataFrame, prefix: str, k: int, namespaces: list[str] | None = None) -> DataFrame:
    """The first k terms with a prefix, in order, with the documents that hold them."""
    rows = postings.where(F.col("term").startswith(prefix))
    if namespaces:
        rows = rows.where(F.col("namespace").isin(namespaces))
    return rows.groupBy("term").agg(F.countDistinct("doc_id").alias("hits")).orderBy("term").limit(k)
