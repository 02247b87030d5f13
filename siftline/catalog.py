"""Every registered query of the search engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions.text import FROM, RX, TO, cut_bytes, normalize_latin
from siftline.operators import index, project, rank, schema, score, snippet, store
from siftline.plans import match, query
from siftline.sources import tables as S

NOW = S.NOW_MS
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _quote(s: str) -> str:
    return s.replace("'", "''")


_CUT = "CASE WHEN strlen(t) <= 30 THEN t ELSE list_filter(list_transform(range(30, 6, -1), lambda n: left(t, CAST(n AS BIGINT))), lambda s: strlen(s) <= 30)[1] END"
_NORM = f"translate(lower(v), '{FROM}', '{TO}')"
_BASE = f"""
WITH d AS (SELECT doc_id, source AS namespace, lang AS schema, CAST(doc_id AS VARCHAR) AS uri, CAST(n_chars % 100 AS INTEGER) AS score_input, 1700000000000 + doc_id * 1000 AS creation_ts_ms,
  CASE WHEN doc_id % 7 = 0 THEN 500000 ELSE 0 END AS ttl_ms, text FROM documents),
alive AS (SELECT * FROM d WHERE ttl_ms = 0 OR {NOW} < creation_ts_ms + ttl_ms),
sec AS (SELECT doc_id, namespace, schema, 0 AS section_id, 'body' AS path, true AS in_prefix_section, text AS v FROM d
  UNION ALL SELECT doc_id, namespace, schema, 1, 'subject', false, left(text, 40) FROM d),
tk AS (SELECT * EXCLUDE (v), list_filter(regexp_extract_all({_NORM}, '{_quote(RX)}'), lambda t: NOT starts_with(t, '_')) AS terms FROM sec),
room AS (SELECT *, 13107 - coalesce(sum(len(terms)) OVER (PARTITION BY doc_id ORDER BY section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS space FROM tk),
ex AS (SELECT doc_id, namespace, schema, section_id, path, in_prefix_section, unnest(terms[1:greatest(space, 0)]) AS t FROM room),
post AS (SELECT {_CUT} AS term, doc_id, section_id, path, in_prefix_section, namespace, schema, CAST(least(count(*), 255) AS INTEGER) AS tf FROM ex GROUP BY ALL),
dl AS (SELECT d.doc_id, d.namespace, d.schema, CAST(coalesce(sum(len(terms)), 0) AS BIGINT) AS dl FROM d LEFT JOIN tk USING (doc_id) GROUP BY ALL),
cs AS (SELECT namespace, schema, count(*) AS n_docs, CAST(least(sum(dl), 2147483647) AS BIGINT) AS sum_len, least(sum(dl), 2147483647) / (1 + count(*)) AS avgdl FROM dl GROUP BY ALL),
us AS (SELECT user_id AS doc_id, count(*) FILTER (event_type = 'view') AS cnt1, count(*) FILTER (event_type = 'click') AS cnt2, count(*) FILTER (event_type = 'purchase') AS cnt3,
  coalesce(max(CAST(floor(epoch_ms(ts) / 1000) AS BIGINT)) FILTER (event_type = 'view'), 0) AS last1_s, coalesce(max(CAST(floor(epoch_ms(ts) / 1000) AS BIGINT)) FILTER (event_type = 'click'), 0) AS last2_s,
  coalesce(max(CAST(floor(epoch_ms(ts) / 1000) AS BIGINT)) FILTER (event_type = 'purchase'), 0) AS last3_s FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id)
"""


def _has(cond: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM post WHERE {cond})"


def _t(term: str) -> str:
    return _has(f"term = '{term}'")


def _docs(spark, sf_dir, namespaces=None, types=None) -> DataFrame:
    d = store.doc_filter(S.documents(spark, sf_dir), NOW, namespaces, types)
    return d.withColumnRenamed("score", "score_input").select("doc_id", "namespace", "schema", "uri", "score_input", "creation_ts_ms")


def _match(spark, sf_dir, q: str, prefix: bool = False, namespaces=None, types=None) -> DataFrame:
    return match.match(S.postings(spark, sf_dir), _docs(spark, sf_dir, namespaces, types), query.parse(q), prefix)


def _top(df: DataFrame, k: int = 10, order: str = "desc") -> DataFrame:
    return rank.page(df, 0, k, order).select("doc_id", F.round("score", 6).alias("score"), "rank")


def _top_sql(where: str, value: str, order: str = "DESC", k: int = 10, base: str = "alive") -> str:
    return f"{_BASE} SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score {order}, doc_id {order}) AS rank FROM (SELECT doc_id, {value} AS score FROM {base} WHERE {where})) WHERE rank <= {k}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both words, best document score first."""
    return doc_score_rank(spark, sf_dir)


# tokens, postings, statistics


@register(f"{_BASE} SELECT term, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {_CUT} AS term, count(*) AS n FROM (SELECT unnest(terms) AS t FROM tk WHERE section_id = 0) GROUP BY t) GROUP BY term")
def tokenize_vocab(spark, sf_dir):
    return S.sectioned(spark, sf_dir).where("section_id = 0").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@register(f"SELECT DISTINCT raw, translate(lower(raw), '{FROM}', '{TO}') AS norm FROM (SELECT unnest(regexp_extract_all(text, '{_quote(RX)}')) AS raw FROM documents) WHERE raw <> translate(lower(raw), '{FROM}', '{TO}')")
def normalize_terms(spark, sf_dir):
    raw = S.read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(RX), F.lit(0))).alias("raw")).distinct()
    return raw.withColumn("norm", normalize_latin(F.col("raw"))).where("raw <> norm")


@register(f"{_BASE} SELECT term, doc_id, section_id, tf FROM post WHERE tf >= 5")
def term_freq(spark, sf_dir):
    return S.postings(spark, sf_dir).where("tf >= 5").select("term", "doc_id", "section_id", "tf")


@register(f"{_BASE} SELECT doc_id, dl FROM dl")
def doc_length(spark, sf_dir):
    return S.lengths(spark, sf_dir).select("doc_id", "dl")


@register(f"{_BASE} SELECT namespace, schema, n_docs, sum_len, round(avgdl, 6) AS avgdl FROM cs")
def corpus_stats(spark, sf_dir):
    st = index.corpus_stats(S.lengths(spark, sf_dir))
    return st.select("namespace", "schema", "n_docs", F.col("sum_len").cast("long").alias("sum_len"), F.round("avgdl", 6).alias("avgdl"))


@register(f"{_BASE} SELECT term, count(DISTINCT doc_id) AS docs, bool_or(in_prefix_section) AS has_prefix_hits FROM post GROUP BY term")
def lexicon_stats(spark, sf_dir):
    return index.lexicon(S.postings(spark, sf_dir))


# query forms


def _form(name: str, q: str, where: str, prefix: bool = False) -> None:
    def run(spark, sf_dir):
        return _match(spark, sf_dir, q, prefix).select("doc_id", "namespace")

    run.__name__, run.__doc__ = name, f"Documents for the query {q!r}."
    register(f"{_BASE} SELECT doc_id, namespace FROM alive WHERE {where}")(run)


_form("exact_term", "the", _t("the"))
_form("prefix_term", "th", _has("term = 'th' OR (starts_with(term, 'th') AND in_prefix_section)"), True)
_form("and_terms", "the of", f"{_t('the')} AND {_t('of')}")
_form("and_four_terms", "the of and in", " AND ".join(map(_t, ("the", "of", "and", "in"))))
_form("or_terms", "the OR der", f"({_t('the')} OR {_t('der')})")
_form("or_four_terms", "the OR der OR la OR que", "(" + " OR ".join(map(_t, ("the", "der", "la", "que"))) + ")")
_form("not_term", "the -was", f"{_t('the')} AND NOT {_t('was')}")
_form("nested_group", "(the OR der) (of OR und) -was", f"({_t('the')} OR {_t('der')}) AND ({_t('of')} OR {_t('und')}) AND NOT {_t('was')}")
_form("or_run_merge", "the OR der of OR und", "(" + " OR ".join(map(_t, ("the", "der", "of", "und"))) + ")")
_form("section_restrict", "subject:the", _has("term = 'the' AND path = 'subject'"))
_form("restrict_or_plain", "subject:the OR und", "(" + _has("term = 'the' AND path = 'subject'") + f" OR {_t('und')})")
_form("restrict_hyphen", "subject:of-the", _has("term = 'of' AND path = 'subject'") + f" AND {_t('the')}")
_form("restrict_twice", "subject:the:of", "false")
_form("repeated_term", "the the", _t("the"))
_form("empty_query", "", "true")
_form("only_exclusion", "-the", f"NOT {_t('the')}")


@register(f"{_BASE} SELECT doc_id FROM alive WHERE {_t('the')} AND namespace IN ('src0', 'src3')")
def ns_filter(spark, sf_dir):
    return _match(spark, sf_dir, "the", namespaces=["src0", "src3", "unknown"]).select("doc_id")


@register(f"{_BASE} SELECT doc_id FROM alive WHERE {_t('la')} AND schema IN ('fr', 'es')")
def type_filter(spark, sf_dir):
    return _match(spark, sf_dir, "la", types=["fr", "es"]).select("doc_id")


@register(f"{_BASE} SELECT doc_id, creation_ts_ms, CAST(ttl_ms AS BIGINT) AS ttl_ms FROM d WHERE NOT (ttl_ms = 0 OR {NOW} < creation_ts_ms + ttl_ms)")
def ttl_filter(spark, sf_dir):
    return S.documents(spark, sf_dir).where(store.expired(NOW)).select("doc_id", "creation_ts_ms", "ttl_ms")


@register(f"{_BASE} SELECT doc_id, CAST(bit_or(1 << section_id) AS INTEGER) AS mask, CAST(bit_and(1 << section_id) AS INTEGER) AS intersect_mask, CAST(sum(tf) AS BIGINT) AS f FROM post WHERE term = 'the' GROUP BY doc_id")
def hit_masks(spark, sf_dir):
    h = match.term_hits(S.postings(spark, sf_dir), query.parse("the"))
    return h.select("doc_id", F.col("mask").cast("int").alias("mask"), F.col("intersect_mask").cast("int").alias("intersect_mask"), F.col("f0").cast("long").alias("f"))


# ranking

_BOTH = f"{_t('the')} AND {_t('of')}"


@register(_top_sql(_BOTH, "score_input"))
def doc_score_rank(spark, sf_dir):
    return _top(_match(spark, sf_dir, "the of").withColumn("score", score.simple("document_score", "desc")))


@register(_top_sql(_BOTH, "creation_ts_ms"))
def recency_rank(spark, sf_dir):
    return _top(_match(spark, sf_dir, "the of").withColumn("score", score.simple("creation_timestamp", "desc")))


@register(_top_sql(_BOTH, "creation_ts_ms", "ASC"))
def recency_rank_asc(spark, sf_dir):
    return _top(_match(spark, sf_dir, "the of").withColumn("score", score.simple("creation_timestamp", "asc")), order="asc")


@register(_top_sql(_BOTH, "0.0"))
def none_rank(spark, sf_dir):
    return _top(_match(spark, sf_dir, "the of").withColumn("score", score.simple("none", "desc")))


@register(_top_sql(_BOTH, "1.7976931348623157e308", "ASC"))
def none_rank_asc(spark, sf_dir):
    return _top(_match(spark, sf_dir, "the of").withColumn("score", score.simple("none", "asc")), order="asc")


def _usage(spark, sf_dir):
    return store.usage_scores(S.usage_reports(spark, sf_dir), ["doc_id"], None)


def _used(spark, sf_dir):
    return _match(spark, sf_dir, "the").join(_usage(spark, sf_dir), "doc_id", "left")


_USED = "(SELECT alive.*, cnt1, cnt2, cnt3, last1_s, last2_s, last3_s FROM alive LEFT JOIN us USING (doc_id)) u"


@register(_top_sql(_t("the"), "coalesce(cnt1, 0)", base=_USED))
def usage_count_rank(spark, sf_dir):
    return _top(_used(spark, sf_dir).withColumn("score", score.simple("usage_type1_count", "desc")))


@register(_top_sql(_t("the"), "coalesce(last2_s, 0) * 1000.0", base=_USED))
def usage_last_rank(spark, sf_dir):
    return _top(_used(spark, sf_dir).withColumn("score", score.simple("usage_type2_last_used", "desc")))


def _usage_rank(what: str, value: str) -> None:
    def run(spark, sf_dir):
        return _top(_used(spark, sf_dir).withColumn("score", score.simple(f"usage_type{what}", "desc")))

    run.__name__, run.__doc__ = f"usage_type{what}_rank", f"Best by usage type and figure {what}."
    register(_top_sql(_t("the"), value, base=_USED))(run)


_usage_rank("2_count", "coalesce(cnt2, 0)")
_usage_rank("3_count", "coalesce(cnt3, 0)")
_usage_rank("1_last_used", "coalesce(last1_s, 0) * 1000.0")
_usage_rank("3_last_used", "coalesce(last3_s, 0) * 1000.0")


def _bm25(spark, sf_dir, q: str, prefix: bool = False, namespaces=None) -> DataFrame:
    node = query.parse(q)
    docs, posts = _docs(spark, sf_dir, namespaces), S.postings(spark, sf_dir)
    lengths = S.lengths(spark, sf_dir)
    hits = match.term_hits(posts, node, prefix)
    out = score.bm25f(match.match(posts, docs, node, prefix), hits, docs, lengths, index.corpus_stats(lengths), node)
    return out.select("doc_id", F.round("score", 6).alias("score"))


def _bm25_sql(terms: list[tuple[str, str]], where: str, docs: str = "alive") -> str:
    """terms: (text condition, further condition); where over f0, f1, ..."""
    joins, total = "", "0.0"
    for i, (text, more) in enumerate(terms):
        joins += f" LEFT JOIN (SELECT doc_id, sum(f) AS f{i} FROM (SELECT doc_id, section_id, least(sum(tf), 255) AS f FROM post WHERE ({text}) AND {more} GROUP BY ALL) GROUP BY doc_id) q{i} USING (doc_id)"
        joins += f" LEFT JOIN (SELECT namespace, schema, count(DISTINCT doc_id) AS n{i} FROM post WHERE ({text}) AND doc_id IN (SELECT doc_id FROM {docs}) GROUP BY ALL) c{i} USING (namespace, schema)"
        f, n = f"f{i}", f"coalesce(n{i}, 0)"
        total += f" + CASE WHEN {f} > 0 THEN CASE WHEN {n} <> 0 THEN ln(1 + (n_docs - {n} + 0.5) / ({n} - 0.5)) ELSE 0 END * {f} * 2.2 / ({f} + 1.2 * (0.3 + 0.7 * dl / avgdl)) ELSE 0 END"
    return f"{_BASE} SELECT doc_id, round({total}, 6) AS score FROM (SELECT doc_id, namespace, schema FROM {docs}) a JOIN (SELECT doc_id, dl FROM dl) l USING (doc_id) JOIN cs USING (namespace, schema){joins} WHERE {where}"


@register(_bm25_sql([("term = 'the'", "true")], "f0 > 0"))
def bm25_single(spark, sf_dir):
    return _bm25(spark, sf_dir, "the")


@register(_bm25_sql([("term = 'the'", "true"), ("term = 'und'", "true")], "f0 > 0 OR f1 > 0"))
def bm25_or(spark, sf_dir):
    return _bm25(spark, sf_dir, "the OR und")


@register(_bm25_sql([("term = 'the'", "true")], "f0 > 0"))
def bm25_repeated_term(spark, sf_dir):
    """A term that stands twice in a query scores once."""
    return _bm25(spark, sf_dir, "the the")


@register(_bm25_sql([("term = 'the'", "true"), ("term = 'of'", "true")], "f0 > 0 AND f1 > 0"))
def bm25_and(spark, sf_dir):
    return _bm25(spark, sf_dir, "the of")


@register(_bm25_sql([("term = 'the'", "true")], "f0 > 0 AND " + f"NOT {_t('was')}"))
def bm25_exclusion(spark, sf_dir):
    return _bm25(spark, sf_dir, "the -was")


@register(_bm25_sql([("term = 'the'", "path = 'subject'"), ("term = 'of'", "path = 'body'")], "f0 > 0 OR f1 > 0"))
def bm25_restrict(spark, sf_dir):
    return _bm25(spark, sf_dir, "subject:the OR body:of")


@register(_bm25_sql([("term = 'tho' OR (starts_with(term, 'tho') AND in_prefix_section)", "true")], "f0 > 0"))
def bm25_prefix(spark, sf_dir):
    return _bm25(spark, sf_dir, "tho", prefix=True)


@register(_bm25_sql([("term = 'the'", "true")], "f0 > 0", "(SELECT * FROM alive WHERE namespace IN ('src1', 'src2'))"))
def bm25_ns_filter(spark, sf_dir):
    return _bm25(spark, sf_dir, "the", namespaces=["src1", "src2"])


# pages, groups


def _scored(spark, sf_dir):
    return _match(spark, sf_dir, "the").withColumn("score", score.simple("document_score", "desc"))


@register(_top_sql(_t("the"), "score_input", k=25))
def topk_page1(spark, sf_dir):
    return rank.page(_scored(spark, sf_dir), 0, 25).select("doc_id", "score", "rank")


@register(_top_sql(_t("the"), "score_input", k=50) + " AND rank > 25")
def topk_page2(spark, sf_dir):
    return rank.page(_scored(spark, sf_dir), 1, 25).select("doc_id", "score", "rank")


@register(_top_sql(_t("the"), "score_input", k=0))
def page_of_none(spark, sf_dir):
    return rank.page(_scored(spark, sf_dir), 0, 0).select("doc_id", "score", "rank")


_GROUP = "CASE WHEN namespace IN ('src0', 'src1') THEN 0 WHEN namespace = 'src2' THEN 1 END"


@register(
    f"{_BASE} SELECT doc_id, namespace, CAST(score_input AS DOUBLE) AS score FROM (SELECT *, {_GROUP} AS g, row_number() OVER (PARTITION BY {_GROUP} ORDER BY score_input DESC, doc_id DESC) AS n FROM alive WHERE {_t('the')}) WHERE g IS NULL OR n <= CASE g WHEN 0 THEN 3 ELSE 2 END"
)
def group_limit(spark, sf_dir):
    return rank.group_limit(_scored(spark, sf_dir), [(["src0", "src1"], 3), (["src2", "unknown"], 2)]).select("doc_id", "namespace", "score")


@register(f"{_BASE} SELECT doc_id, CAST(score_input AS DOUBLE) AS score FROM (SELECT * FROM alive WHERE {_t('the')} ORDER BY doc_id DESC LIMIT 100)")
def num_to_score_cap(spark, sf_dir):
    return rank.cap_scored(_scored(spark, sf_dir), 100).select("doc_id", "score")


@register(_top_sql(_BOTH, "score_input").replace("SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score, CAST(rank AS INTEGER) AS rank FROM", "SELECT doc_id, CAST(rank AS INTEGER) AS rank, left(text, 40) AS subject FROM documents JOIN", 1).replace(") WHERE rank <= 10", ") r USING (doc_id) WHERE rank <= 10"))
def retrieve_page(spark, sf_dir):
    """Ranked ids first, documents for the page only."""
    return doc_score_rank(spark, sf_dir).join(S.documents(spark, sf_dir), "doc_id").select("doc_id", "rank", F.element_at("props.subject", 1).alias("subject"))


# mutation and statistics


@register(f"{_BASE} SELECT DISTINCT namespace FROM alive")
def all_namespaces(spark, sf_dir):
    return store.namespaces(S.documents(spark, sf_dir), NOW)


def _left(df: DataFrame) -> DataFrame:
    return store.alive(df, NOW).select("doc_id")


@register(f"{_BASE} SELECT doc_id FROM alive WHERE namespace <> 'src0'")
def delete_by_ns(spark, sf_dir):
    return _left(store.delete_where(S.documents(spark, sf_dir), F.col("namespace") == "src0", NOW))


@register(f"{_BASE} SELECT doc_id FROM alive WHERE schema <> 'fr'")
def delete_by_type(spark, sf_dir):
    return _left(store.delete_where(S.documents(spark, sf_dir), F.col("schema") == "fr", NOW))


@register(f"{_BASE} SELECT doc_id FROM alive WHERE NOT {_t('the')}")
def delete_by_query(spark, sf_dir):
    return _left(store.delete_ids(S.documents(spark, sf_dir), _match(spark, sf_dir, "the")))


@register(f"{_BASE} SELECT doc_id FROM alive WHERE doc_id NOT IN (SELECT user_id FROM events WHERE value > 50 AND user_id IS NOT NULL)")
def delete_by_key(spark, sf_dir):
    docs = S.documents(spark, sf_dir)
    gone = S.read(spark, sf_dir, "events").where("value > 50").select(F.col("user_id").alias("doc_id")).distinct().join(docs, "doc_id").select("namespace", "uri")
    return _left(store.delete_keys(docs, gone, NOW))


@register(f"{_BASE} SELECT max(doc_id) AS doc_id, namespace, CAST(doc_id % 50 AS VARCHAR) AS uri FROM d WHERE ttl_ms = 0 GROUP BY namespace, doc_id % 50")
def upsert_latest(spark, sf_dir):
    log = S.documents(spark, sf_dir).where("ttl_ms = 0").withColumn("uri", (F.col("doc_id") % 50).cast("string"))
    done = store.upsert(log.where("doc_id % 2 = 0"), log.where("doc_id % 2 = 1"), NOW)
    return store.latest(done.where("NOT deleted")).select("doc_id", "namespace", "uri")


@register(f"{_BASE} SELECT * FROM us")
def usage_agg(spark, sf_dir):
    return _usage(spark, sf_dir)


@register(f"{_BASE} SELECT doc_id AS old_doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_id FROM alive")
def optimize_renumber(spark, sf_dir):
    return store.optimize(S.documents(spark, sf_dir), NOW).select("old_doc_id", F.col("doc_id").cast("long").alias("doc_id"))


@register(f"{_BASE} SELECT count(*) - (SELECT count(*) FROM alive) AS optimizable_docs, count(*) AS total_docs, CAST(floor(1000000.0 * (count(*) - (SELECT count(*) FROM alive)) / count(*)) AS BIGINT) AS estimated_optimizable_bytes, CAST({NOW} AS BIGINT) AS time_since_last_optimize_ms FROM d")
def optimize_info(spark, sf_dir):
    return store.optimize_info(S.documents(spark, sf_dir), NOW, 1_000_000)


_ALIVE = f"(ttl_ms = 0 OR {NOW} < creation_ts_ms + ttl_ms)"


@register(f"{_BASE} SELECT namespace, count(*) FILTER ({_ALIVE}) AS alive, count(*) FILTER (NOT {_ALIVE}) AS expired, CAST(0 AS BIGINT) AS deleted, " + ", ".join(f"count(*) FILTER ({_ALIVE} AND cnt{t} > 0) AS alive_type{t}, count(*) FILTER (NOT {_ALIVE} AND cnt{t} > 0) AS expired_type{t}" for t in (1, 2, 3)) + " FROM d LEFT JOIN us USING (doc_id) GROUP BY namespace")
def storage_info(spark, sf_dir):
    return store.storage_info(S.documents(spark, sf_dir), NOW, _usage(spark, sf_dir))


@register(f"{_BASE} SELECT term, count(DISTINCT doc_id) AS hits FROM post WHERE starts_with(term, 'an') AND namespace IN ('src0', 'src1') GROUP BY term ORDER BY term LIMIT 20")
def suggest_prefix(spark, sf_dir):
    return index.suggest(S.postings(spark, sf_dir), "an", 20, ["src0", "src1"])


@register(f"{_BASE} SELECT term, count(*) AS n FROM post WHERE doc_id <= (SELECT max(doc_id) // 2 FROM documents) GROUP BY term")
def truncate_to(spark, sf_dir):
    """Postings cut to the document store's last id, after a delta of the newer half was merged in."""
    p = S.postings(spark, sf_dir)
    last = S.read(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0
    return index.merge_postings(p.where("doc_id % 2 = 0"), p.where("doc_id % 2 = 1"), last // 2).groupBy("term").agg(F.count("*").alias("n"))


# shaping


@register("SELECT conv_id AS doc_id, list(text ORDER BY turn) AS texts, true AS roles_gone FROM conversations GROUP BY conv_id")
def projection_nested(spark, sf_dir):
    p = project.project(S.conversations(spark, sf_dir), [("Conversation", ["turns", "turns.text"])])
    return p.select("doc_id", F.flatten("props.turns.text").alias("texts"), (F.col("props.first").isNull() & F.forall("props.turns.role", lambda r: r.isNull())).alias("roles_gone"))


_DOC_SCHEMA = schema.Schema((schema.Type("en", (schema.email_prop("body", "prefix", "required"), schema.email_prop("subject", "exact"))), schema.Type("de", (schema.email_prop("body", "prefix", "required"),)), schema.Type("fr", (schema.email_prop("body"), schema.email_prop("subject")))))


@register("SELECT CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'NOT_FOUND: schema type' WHEN n_chars % 100 < 10 THEN 'INVALID_ARGUMENT: score is negative' WHEN lang = 'de' THEN 'NOT_FOUND: de.subject' END AS error, count(*) AS n FROM documents GROUP BY ALL")
def doc_validate(spark, sf_dir):
    d = S.documents(spark, sf_dir).withColumn("score", F.col("score") - 10)
    return d.select(schema.row_error(_DOC_SCHEMA).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


_ASTRAL = "length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
_SNIPPETS = f"""{_BASE}, r AS (SELECT doc_id, text, row_number() OVER (ORDER BY score_input DESC, doc_id DESC) AS rank FROM alive WHERE {_t('the')}),
v AS (SELECT doc_id, rank, 0 AS sec, 'body' AS path, text AS v FROM r WHERE rank <= 10 UNION ALL SELECT doc_id, rank, 1, 'subject', left(text, 40) FROM r WHERE rank <= 10),
w AS (SELECT *, regexp_extract_all(v, '{_quote(RX)}') AS w, regexp_split_to_array(v, '{_quote(RX)}') AS p FROM v),
j AS (SELECT *, unnest(range(1, len(w) + 1)) AS j FROM w),
m AS (SELECT doc_id, rank, sec, path, j, w[j] AS word, left(v, CAST(list_sum(list_transform(p[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:j - 1], lambda x: length(x))), 0) AS BIGINT)) AS head
  FROM j WHERE translate(lower(w[j]), '{FROM}', '{TO}') = 'the'),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY j) AS n FROM m)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, j) - 1 AS INTEGER) AS i, path, CAST(strlen(head) AS INTEGER) AS byte_pos, CAST(strlen(word) AS INTEGER) AS byte_len,
  CAST(length(head) + {_ASTRAL.format('head')} AS INTEGER) AS utf16_pos, CAST(length(word) + {_ASTRAL.format('word')} AS INTEGER) AS utf16_len FROM k WHERE n <= 5"""


def _snippets(spark, sf_dir):
    top = rank.page(_scored(spark, sf_dir), 0, 20)
    rows = top.select("doc_id", "score", "rank").join(S.documents(spark, sf_dir).select("doc_id", "schema", "props"), "doc_id")
    secs = [schema.Section(t, s.section_id, s.path, s.match, s.tokenizer) for t in ("en", "de", "fr", "es") for s in S.SECTIONS]
    got = snippet.snippet(rows, secs, query.leaves(query.parse("the")), False, 10, 5, 40)
    return got.select("doc_id", "rank", F.posexplode("snippets").alias("i", "s")).select("doc_id", "rank", "i", "s.*")


@register(_SNIPPETS)
def snippet_offsets(spark, sf_dir):
    """Where the first matches of the ten best stand, in bytes and UTF-16 units."""
    return _snippets(spark, sf_dir).select("doc_id", "rank", "i", "path", "byte_pos", "byte_len", "utf16_pos", "utf16_len")


_ERAS = """
WITH d AS (SELECT doc_id, source AS namespace, CAST(doc_id % 50 AS VARCHAR) AS uri, doc_id * 1000 AS put_ms, CAST(doc_id % 3 = 0 AS INTEGER) AS fresh FROM documents),
e AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY namespace, uri ORDER BY doc_id), 0) AS era FROM d),
b AS (SELECT *, lead(f) OVER (PARTITION BY namespace, uri ORDER BY era) AS t FROM (SELECT namespace, uri, era, min(put_ms) AS f FROM e GROUP BY ALL)),
r AS (SELECT d.namespace, d.uri, event_type, epoch_ms(ts) AS ms, epoch_ms(ts) % 1000000 AS reported_ms FROM events JOIN d ON user_id = d.doc_id WHERE event_type IN ('view', 'click', 'purchase')),
u AS (SELECT b.namespace, b.uri, b.era, """ + ", ".join(f"count(*) FILTER (event_type = '{k}') AS cnt{t}, coalesce(max(CAST(floor(ms / 1000) AS BIGINT)) FILTER (event_type = '{k}'), 0) AS last{t}_s" for t, k in ((1, "view"), (2, "click"), (3, "purchase"))) + """
  FROM r JOIN b ON r.namespace = b.namespace AND r.uri = b.uri AND reported_ms >= f AND (t IS NULL OR reported_ms < t) GROUP BY ALL)
SELECT doc_id, """ + ", ".join(f"coalesce({c}{t}{x}, 0) AS {c}{t}{x}" for t in (1, 2, 3) for c, x in (("cnt", ""), ("last", "_s"))) + """ FROM e LEFT JOIN u ON e.namespace = u.namespace AND e.uri = u.uri AND e.era = u.era"""


@register(_ERAS)
def usage_carry(spark, sf_dir):
    """Generations of a key share its usage until the key is deleted."""
    d = S.documents(spark, sf_dir).select("doc_id", "namespace", (F.col("doc_id") % 50).cast("string").alias("uri"))
    log = d.withColumns({"put_ms": F.col("doc_id") * 1000, "fresh": F.col("doc_id") % 3 == 0})
    reports = S.usage_reports(spark, sf_dir).join(d, "doc_id").drop("doc_id").withColumn("reported_ms", F.col("usage_timestamp_ms") % 1_000_000)
    return store.carry_usage(log, reports, None).select("doc_id", *(f"{c}{t}{x}" for t in store.TYPES for c, x in (("cnt", ""), ("last", "_s"))))


@register("SELECT conv_id AS doc_id, list(role ORDER BY turn) AS roles, true AS texts_gone FROM conversations GROUP BY conv_id")
def projection_own_type_first(spark, sf_dir):
    """A mask of the document's own type goes before the one for all types."""
    p = project.project(S.conversations(spark, sf_dir), [("*", ["turns", "turns.text"]), ("Conversation", ["turns", "turns.role"])])
    return p.select("doc_id", F.flatten("props.turns.role").alias("roles"), F.forall("props.turns.text", lambda t: t.isNull()).alias("texts_gone"))


@register(f"{_BASE} SELECT namespace, term, docs FROM (SELECT namespace, term, docs, row_number() OVER (PARTITION BY namespace ORDER BY docs DESC, term) AS n FROM (SELECT namespace, term, count(DISTINCT doc_id) AS docs FROM post WHERE strlen(term) > 4 GROUP BY ALL)) WHERE n <= 5")
def top_terms(spark, sf_dir):
    c = S.postings(spark, sf_dir).where(F.octet_length("term") > 4).groupBy("namespace", "term").agg(F.count_if("first_of_namespace").alias("docs"))
    return c.withColumn("n", F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc("docs"), "term"))).where("n <= 5").drop("n")


@register("SELECT doc_id, CASE WHEN strlen(t) <= 30 THEN t ELSE left(t, 30) END AS cut, CAST(strlen(t) AS INTEGER) AS n FROM (SELECT doc_id, regexp_replace(text, '[^a-z]', '', 'g') AS t FROM documents)")
def cut_terms(spark, sf_dir):
    t = S.read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^a-z]", "").alias("t"))
    return t.select("doc_id", cut_bytes(F.col("t")).alias("cut"), F.octet_length("t").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
