"""The search engine: a session's tables and the operations on them."""

from __future__ import annotations

import json
import time
import uuid
import zlib
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import index, project, rank, schema, score, snippet, store
from siftline.plans import match, query

OK, NOT_FOUND, INVALID, EXISTS, FAILED, DATA_LOSS = "OK", "NOT_FOUND", "INVALID_ARGUMENT", "ALREADY_EXISTS", "FAILED_PRECONDITION", "WARNING_DATA_LOSS"
MOST_DELTAS = 8
DOC_COLUMNS = "doc_id long, namespace string, uri string, schema string, creation_ts_ms long, ttl_ms long, score int, deleted boolean"


class EngineError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class SearchSpec:
    query: str = ""
    prefix: bool = False
    namespaces: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    rank_by: str = "document_score"
    order: str = "desc"
    per_page: int = rank.PAGE
    groups: list[tuple[list[str], int]] = field(default_factory=list)
    masks: list[tuple[str, list[str]]] = field(default_factory=list)
    num_to_snippet: int = 0
    matches_per_property: int = 100
    max_window: int = 160
    num_to_score: int = rank.NUM_TO_SCORE


@dataclass
class SearchResult:
    rows: DataFrame
    token: int
    stats: dict


class SearchEngine:
    """`path`: where tables persist; None keeps them in the session. `clock` gives milliseconds."""

    def __init__(self, spark: SparkSession, path: str | None = None, clock=None, normalizer: str = "latin", max_tokens: int = 13_107):
        if max_tokens <= 0:
            raise EngineError(INVALID, "max_tokens_per_doc must be positive")
        self.spark, self.path, self.normalizer, self.max_tokens = spark, path, normalizer, max_tokens
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.schema = schema.Schema()
        self.docs: DataFrame | None = None
        self.usage: DataFrame | None = None
        self.cursors = rank.Cursors()
        self.last_optimize_ms = 0
        self._specs: dict[int, SearchSpec] = {}
        #: What is indexed; documents put since, which the next search indexes alone; how many such deltas lie on the base.
        self._indexed: tuple | None = None
        self._pending: DataFrame | None = None
        self.deltas = 0

    # tables

    def initialize(self) -> dict:
        """Load the last complete state; derived tables are recomputed from the documents.

        A state is a small file that names the folders of its tables, with a checksum of itself. One that is torn, or
        whose folders are gone, is passed over for the one before it, and the status says that data was lost.
        """
        self.cursors.clear()
        status = OK
        for name in reversed(self._states()):
            state = self._read_state(name)
            if state is None:
                status = DATA_LOSS
                continue
            self.schema = decode_schema(state["schema"]) if state["schema"] else schema.Schema()
            self.docs = self.spark.read.parquet(f"{self.path}/{state['documents']}") if state["documents"] else None
            self.usage = self.spark.read.parquet(f"{self.path}/{state['usage']}") if state["usage"] else None
            break
        self._forget_index()
        return {"status": status, "num_documents": self.docs.count() if self.docs is not None else 0, "num_schema_types": len(self.schema.types)}

    def _fs(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _states(self) -> list[str]:
        if not self.path:
            return []
        fs, p = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if n.startswith("state-"))

    def _read_state(self, name: str) -> dict | None:
        fs, p = self._fs(name)
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Py4JJavaError as e:  # the file system's own check failed
            if "ChecksumException" not in str(e.java_exception.getClass()):
                raise
            return None
        finally:
            stream.close()
        crc, _, body = text.partition("\n")
        if crc != str(zlib.crc32(body.encode())):
            return None
        state = json.loads(body)
        return state if all(not state[k] or fs.exists(self._fs(state[k])[1]) for k in ("documents", "usage")) else None

    def persist(self, full: bool = True) -> None:
        """LITE writes the documents only; FULL also usage and schema. What the session holds stays as it is.

        Tables go to folders of their own; a new state is written after they are complete, and only then the old ones go.
        """
        if not self.path:
            raise EngineError(FAILED, "no path")
        names = self._states()
        number = int(names[-1].removeprefix("state-")) + 1 if names else 0
        old = next((x for x in map(self._read_state, reversed(names)) if x), {"documents": None, "usage": None, "schema": None})
        state = dict(old)
        for name, df in [("documents", self.docs)] + ([("usage", self.usage)] if full else []):
            state[name] = None
            if df is not None:
                state[name] = f"{name}-{number:09d}"
                df.write.mode("overwrite").parquet(f"{self.path}/{state[name]}")
        if full or not old["schema"]:  # documents without their schema could not be read
            state["schema"] = encode_schema(self.schema)
        body = json.dumps(state)
        fs, p = self._fs(f"state-{number:09d}")
        out = fs.create(p, True)
        try:
            out.write(f"{zlib.crc32(body.encode())}\n{body}".encode())
        finally:
            out.close()
        if state["documents"]:
            self.docs = self.spark.read.parquet(f"{self.path}/{state['documents']}")
        if full and state["usage"]:
            self.usage = self.spark.read.parquet(f"{self.path}/{state['usage']}")
        for name in names[:-1]:  # the state before this one stays, to fall back on
            gone = self._read_state(name) or {}
            fs.delete(self._fs(name)[1], True)
            for k in ("documents", "usage"):
                if gone.get(k) and gone[k] not in (state[k], old[k]):
                    fs.delete(self._fs(gone[k])[1], True)

    def reset(self) -> None:
        if self.path:
            fs, p = self._fs()
            fs.delete(p, True)
        self.schema, self.docs, self.usage = schema.Schema(), None, None
        self._forget_index()
        self.cursors.clear()

    def _forget_index(self) -> None:
        for t in self._indexed or ():
            t.unpersist()
        self._indexed, self._pending, self.deltas = None, None, 0

    def _changed(self, docs: DataFrame, reindex: bool = True) -> None:
        self.docs = docs
        if reindex:
            self._forget_index()

    def index(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(postings, lengths, corpus statistics). Documents put since the last call are indexed alone, as a delta on what is there.

        After `MOST_DELTAS` of them the index is compacted: written anew, sorted by term, where the engine has a path.
        """
        if self._indexed is not None and self._pending is None:
            return self._indexed
        new = self.docs if self._indexed is None else self._pending
        sectioned = index.section_tokens(new, schema.sections(self.schema), self.normalizer)
        postings, lengths = index.build_postings(sectioned, self.max_tokens), index.doc_lengths(new, sectioned)
        if self._indexed is not None:
            postings, lengths = self._indexed[0].unionByName(postings), self._indexed[1].unionByName(lengths)
            self.deltas += 1
        lengths = lengths.persist()
        self._indexed, self._pending = (postings.persist(), lengths, index.corpus_stats(lengths)), None
        if self.deltas > MOST_DELTAS:
            self.compact()
        return self._indexed

    def compact(self) -> None:
        """One index of base and deltas, without what documents no longer hold."""
        postings, lengths, _ = self.index()
        kept = postings.join(self.docs.where("NOT deleted").select("doc_id"), "doc_id", "left_semi")
        if self.path:
            at, n = f"{self.path}/index-{uuid.uuid4().hex}", max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            index.write_postings(kept, f"{at}/postings", n)
            lengths.write.parquet(f"{at}/lengths")
            old, self._index_at = getattr(self, "_index_at", None), at
            self._forget_index()
            made = self.spark.read.parquet(f"{at}/postings"), self.spark.read.parquet(f"{at}/lengths")
            if old:
                fs, p = self._fs(old.removeprefix(f"{self.path}/"))
                fs.delete(p, True)
        else:
            made = kept.persist(), lengths
            made[0].count()
            postings.unpersist()
        self._indexed, self.deltas = (*made, index.corpus_stats(made[1])), 0

    # schema

    def set_schema(self, new: schema.Schema, ignore_errors: bool = False) -> dict:
        schema.validate(new)
        if new == self.schema:
            return {"status": OK, "deleted": [], "incompatible": []}
        d = schema.compare(self.schema, new)
        if (d.deleted or d.incompatible) and not ignore_errors:
            return {"status": FAILED, "deleted": sorted(d.deleted), "incompatible": sorted(d.incompatible)}
        self.schema = new
        if self.docs is not None:
            wide = self._shape(self.docs)
            bad = F.col("_error").isNotNull()
            checked = wide.withColumn("_error", schema.row_error(new))
            self._changed(checked.withColumn("deleted", F.col("deleted") | bad).drop("_error"))
        return {"status": OK, "deleted": sorted(d.deleted), "incompatible": sorted(d.incompatible), "reindexed": sorted(d.index_incompatible)}

    def _shape(self, df: DataFrame) -> DataFrame:
        """props as the schema's struct, by name; what the schema no longer has goes."""
        want = schema.all_props(self.schema)
        have = {f.name: f.dataType for f in df.schema["props"].dataType.fields} if "props" in df.columns else {}
        cols = [(F.col(f"props.{f.name}") if have.get(f.name) == f.dataType else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return df.withColumn("props", F.struct(*cols) if cols else F.struct(F.lit(None).cast("array<string>").alias("_none")))

    def get_schema(self) -> schema.Schema:
        if not self.schema.types:
            raise EngineError(NOT_FOUND, "no schema is set")
        return self.schema

    def get_schema_type(self, name: str) -> schema.Type:
        try:
            return self.schema[name]
        except schema.SchemaError as e:
            raise EngineError(e.code, str(e)) from e

    # documents

    def put(self, batch: DataFrame) -> DataFrame:
        """Upsert rows (namespace, uri, schema, score, creation_ts_ms, ttl_ms, props). Returns the refused rows with their error."""
        for name, kind in (("score", "int"), ("creation_ts_ms", "long"), ("ttl_ms", "long")):
            batch = batch.withColumn(name, F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind)) if name in batch.columns else F.lit(0).cast(kind))
        checked = self._shape(batch).withColumn("_error", schema.row_error(self.schema)).persist()
        good = checked.where("_error IS NULL").drop("_error")
        last = None if self.docs is None else self.docs.agg(F.max("doc_id")).first()[0]
        first = 0 if last is None else last + 1
        order = "_order" if "_order" in batch.columns else "uri"
        cols = ["doc_id", "namespace", "uri", "schema", "creation_ts_ms", "ttl_ms", "score", "deleted", "props"]
        # written, so that a lost executor cannot number rows again in another order
        rows = store.write_once(store.number(good, first, order).withColumn("deleted", F.lit(False)).select(*cols))
        now = self.clock()
        base = self.docs if self.docs is not None else rows.limit(0)
        if self.usage is not None:  # a key that is not alive starts from no usage
            fresh = rows.select("namespace", "uri").distinct().join(store.alive(base, now).select("namespace", "uri"), ["namespace", "uri"], "left_anti")
            self.usage = store.write_once(self.usage.join(fresh, ["namespace", "uri"], "left_anti"))
        new = store.upsert(base.select(*cols), rows, now)
        pending = new.where(F.col("doc_id") >= first)
        self._changed(new, reindex=False)
        if self._indexed is not None:
            self._pending = pending if self._pending is None else self._pending.unionByName(pending)
        refused = store.write_once(checked.where("_error IS NOT NULL"))
        checked.unpersist()
        return refused

    def get(self, namespace: str, uri: str, masks: list[tuple[str, list[str]]] | None = None) -> dict:
        rows = store.alive(self.docs, self.clock()).where((F.col("namespace") == namespace) & (F.col("uri") == uri))
        got = project.project(rows, masks or [], last_wins=True).limit(1).collect()
        if not got:
            raise EngineError(NOT_FOUND, f"document ({namespace}, {uri}) not found")
        return got[0].asDict(recursive=True)

    def _delete(self, condition, what: str) -> int:
        n = store.alive(self.docs, self.clock()).where(condition).count()
        if not n:
            raise EngineError(NOT_FOUND, f"{what} not found")
        self._changed(store.delete_where(self.docs, condition, self.clock()), reindex=False)
        return n

    def delete(self, namespace: str, uri: str) -> int:
        return self._delete((F.col("namespace") == namespace) & (F.col("uri") == uri), f"document ({namespace}, {uri})")

    def delete_by_namespace(self, namespace: str) -> int:
        return self._delete(F.col("namespace") == namespace, f"namespace {namespace}")

    def delete_by_type(self, name: str) -> int:
        return self._delete(F.col("schema") == name, f"type {name}")

    def delete_by_query(self, spec: SearchSpec) -> int:
        ids = store.write_once(self._matched(spec)[0].select("doc_id"))
        n = ids.count()
        if not n:
            raise EngineError(NOT_FOUND, "no document matches")
        self._changed(store.delete_ids(self.docs, ids), reindex=False)
        return n

    def report_usage(self, reports: DataFrame) -> int:
        """Reports of alive documents are added; returns how many named none."""
        live = store.alive(self.docs, self.clock()).select("namespace", "uri", "doc_id")
        rows = reports.join(live, ["namespace", "uri"], "left")
        known = store.write_once(rows.where("doc_id IS NOT NULL").select("namespace", "uri", "usage_timestamp_ms", "usage_type"))
        self.usage = known if self.usage is None else self.usage.unionByName(known)
        return rows.where("doc_id IS NULL").count()

    def all_namespaces(self) -> DataFrame:
        return store.namespaces(self.docs, self.clock())

    def optimize(self) -> dict:
        before = self.docs.count()
        self._changed(store.write_once(store.optimize(self.docs, self.clock()).drop("old_doc_id").select(*self.docs.columns)))
        self.cursors.clear()
        self.last_optimize_ms = self.clock()
        return {"status": OK, "num_original_documents": before, "num_kept_documents": self.docs.count()}

    def optimize_info(self, size_bytes: int = 0) -> dict:
        return store.optimize_info(self.docs, self.clock(), size_bytes, self.last_optimize_ms).first().asDict()

    def storage_info(self) -> DataFrame:
        usage = None
        if self.usage is not None:
            live = self.docs.select("doc_id", "namespace", "uri")
            usage = live.join(store.usage_scores(self.usage, ["namespace", "uri"]), ["namespace", "uri"]).drop("namespace", "uri")
        return store.storage_info(self.docs, self.clock(), usage)

    def suggest(self, prefix: str, k: int = 10, namespaces: list[str] | None = None) -> DataFrame:
        return index.suggest(self.index()[0], query.normalize_term(prefix), k, namespaces)

    # search

    def _matched(self, spec: SearchSpec):
        node = query.parse(spec.query)
        docs = store.doc_filter(self.docs, self.clock(), spec.namespaces, spec.types).withColumnRenamed("score", "score_input")
        slim = docs.select("doc_id", "namespace", "schema", "uri", "score_input", "creation_ts_ms")
        return match.match(self.index()[0], slim, node, spec.prefix), slim, node

    def scored(self, spec: SearchSpec) -> DataFrame:
        matched, slim, node = self._matched(spec)
        matched = rank.cap_scored(matched, spec.num_to_score)
        if spec.rank_by == "relevance":
            postings, lengths, stats = self.index()
            hits = match.term_hits(postings, node, spec.prefix) if query.leaves(node) else None
            return score.bm25f(matched, hits, slim, lengths, stats, node)
        if spec.rank_by.startswith("usage") and self.usage is not None:
            matched = matched.join(store.usage_scores(self.usage, ["namespace", "uri"]), ["namespace", "uri"], "left")
        elif spec.rank_by.startswith("usage"):
            matched = matched.withColumns({k: F.lit(v) for k, v in store.ZERO_USAGE.items()})
        return matched.withColumn("score", score.simple(spec.rank_by, spec.order))

    def search(self, spec: SearchSpec) -> SearchResult:
        """First page and a token. Ids and scores are ranked alone; documents join for the page only."""
        start = time.time()
        if spec.per_page < 0 or spec.num_to_score <= 0:
            raise EngineError(INVALID, "num_per_page must not be negative, num_to_score must be positive")
        node = query.parse(spec.query)
        limited = rank.group_limit(self.scored(spec).select("doc_id", "namespace", "schema", "score", "mask"), spec.groups, spec.order)
        ranked = rank.page(limited, 0, rank.CACHED_HITS, spec.order).persist()
        total = ranked.count()
        token = self.cursors.add(ranked, total, spec.per_page)
        self._specs = {k: v for k, v in self._specs.items() if k in self.cursors.held}
        if token:
            self._specs[token] = spec
        rows = self.retrieve(ranked.where(F.col("rank") <= spec.per_page), spec)
        by_path: dict = {}
        for t in query.leaves(node):
            by_path.setdefault(t.path, set()).add(t.text)
        stats = {
            "query_length": len(spec.query), "num_terms": sum(map(len, by_path.values())), "num_namespaces_filtered": len(spec.namespaces), "num_schema_types_filtered": len(spec.types),
            "ranking_strategy": spec.rank_by, "num_documents_scored": min(total, spec.num_to_score), "requested_page_size": spec.per_page, "num_results_returned_current_page": min(total, spec.per_page),
            "num_results_with_snippets": min(total, spec.per_page, spec.num_to_snippet), "is_first_page": True, "executed_query": str(node), "latency_ms": int((time.time() - start) * 1000),
        }
        return SearchResult(rows, token, stats)

    def retrieve(self, ranked: DataFrame, spec: SearchSpec) -> DataFrame:
        rows = ranked.select("doc_id", "score", "rank").join(self.docs.select("doc_id", "namespace", "uri", "schema", "props"), "doc_id")
        rows = project.project(rows, spec.masks)
        if spec.num_to_snippet > 0:
            terms = query.leaves(query.parse(spec.query))
            rows = snippet.snippet(rows, schema.sections(self.schema), terms, spec.prefix, spec.num_to_snippet, spec.matches_per_property, spec.max_window)
        return rows.orderBy("rank")

    def next_page(self, token: int) -> SearchResult:
        """An unknown or used-up token gives an empty page."""
        ranked, again = self.cursors.next(token)
        spec = self._specs.get(token)
        if ranked is None or spec is None:
            return SearchResult(self.spark.createDataFrame([], "doc_id long, score double, rank int"), 0, {"is_first_page": False})
        return SearchResult(self.retrieve(ranked, spec), again, {"is_first_page": False})

    def invalidate(self, token: int) -> None:
        self.cursors.drop(token)


def encode_schema(s: schema.Schema) -> str:
    return json.dumps([{"name": t.name, "version": t.version, "properties": [vars(p) for p in t.properties]} for t in s.types])


def decode_schema(text: str) -> schema.Schema:
    return schema.Schema(tuple(schema.Type(t["name"], tuple(schema.Property(**p) for p in t["properties"]), t["version"]) for t in json.loads(text)))
