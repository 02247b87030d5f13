import pytest

from siftline.engine import EngineError, SearchEngine, SearchSpec
from siftline.operators import rank, schema, snippet
from siftline.operators.project import tree
from siftline.operators.schema import Property, Schema, SchemaError, Type, email_prop
from siftline.plans.query import Term

EMAIL = Schema((Type("Email", (email_prop("body"), email_prop("subject"))),))


def put(spark, engine, rows, types="namespace string, uri string, schema string, score int, creation_ts_ms long, ttl_ms long, props struct<body:array<string>,subject:array<string>>, _order int"):
    return engine.put(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], types)).count()


def mail(uri, subject, body, ns="ns", score=0, at=1000, ttl=0):
    return (ns, uri, "Email", score, at, ttl, ([body], [subject]))


@pytest.fixture
def engine(spark):
    e = SearchEngine(spark, clock=lambda: 10_000)
    assert e.set_schema(EMAIL)["status"] == "OK"
    return e


def uris(result):
    return [r.uri for r in result.rows.collect()]


def test_relevance_of_equal_lengths(spark, engine):
    # ten tokens each, three documents, all hold the term
    pad = " ".join(f"w{i}" for i in range(8))
    put(spark, engine, [mail(str(i), "foo", f"{pad} x{i}") for i in range(3)])
    got = engine.search(SearchSpec("foo", rank_by="relevance")).rows.collect()
    assert [round(r.score, 6) for r in got] == [0.161737] * 3
    assert [r.uri for r in got] == ["2", "1", "0"]


def test_put_get_delete(spark, engine):
    assert put(spark, engine, [mail("a", "one", "puppy dog"), mail("b", "two", "kitten cat"), ("", "x", "Email", 0, 0, 0, ([], [])), ("ns", "y", "None", 0, 0, 0, ([], []))]) == 2
    put(spark, engine, [mail("a", "one again", "animal")])
    assert engine.get("ns", "a")["props"]["body"] == ["animal"]
    assert engine.get("ns", "a", [("Email", ["subject"])])["props"] == {"body": None, "subject": ["one again"]}
    assert uris(engine.search(SearchSpec("puppy"))) == []
    assert uris(engine.search(SearchSpec("anim", prefix=True))) == ["a"]
    assert uris(engine.search(SearchSpec(""))) == ["a", "b"]
    engine.delete("ns", "a")
    with pytest.raises(EngineError) as err:
        engine.delete("ns", "a")
    assert err.value.code == "NOT_FOUND"
    assert engine.delete_by_query(SearchSpec("kitten")) == 1
    assert uris(engine.search(SearchSpec(""))) == []
    info = engine.optimize_info()
    assert info["optimizable_docs"] == info["total_docs"] == 3
    assert engine.optimize()["num_kept_documents"] == 0


def test_ttl_usage_and_storage(spark, engine):
    put(spark, engine, [mail("a", "t", "word", at=1000, ttl=500), mail("b", "t", "word", ns="n2"), mail("c", "t", "word", ttl=2**62, at=2**62)])
    assert sorted(uris(engine.search(SearchSpec("word")))) == ["b", "c"]
    assert {r.namespace for r in engine.all_namespaces().collect()} == {"ns", "n2"}
    reports = [("n2", "b", 5000, 1), ("n2", "b", 3000, 1), ("ns", "c", 9000, 1), ("ns", "a", 1, 1)]
    assert engine.report_usage(spark.createDataFrame(reports, "namespace string, uri string, usage_timestamp_ms long, usage_type int")) == 1
    assert uris(engine.search(SearchSpec("word", rank_by="usage_type1_count"))) == ["b", "c"]
    assert uris(engine.search(SearchSpec("word", rank_by="usage_type1_last_used"))) == ["c", "b"]
    got = {r.namespace: r for r in engine.storage_info().collect()}
    assert (got["ns"].alive, got["ns"].expired, got["n2"].alive_type1) == (1, 1, 1)


def test_pages_groups_and_snippets(spark, engine):
    put(spark, engine, [mail(str(i), "s", "word " * (i + 1), ns=f"n{i % 3}", score=i) for i in range(9)])
    r = engine.search(SearchSpec("word", per_page=4))
    assert uris(r) == ["8", "7", "6", "5"] and r.token
    r2 = engine.next_page(r.token)
    assert uris(r2) == ["4", "3", "2", "1"]
    r3 = engine.next_page(r2.token)
    assert uris(r3) == ["0"] and r3.token == 0
    assert engine.next_page(r.token).rows.count() == 0
    assert uris(engine.search(SearchSpec("word", groups=[(["n0", "n1"], 2)]))) == ["8", "7", "6", "5", "2"]
    rows = engine.search(SearchSpec("word", num_to_snippet=2, matches_per_property=3, max_window=9)).rows.collect()
    assert [len(x.snippets) for x in rows] == [3, 3, 0, 0, 0, 0, 0, 0, 0]
    assert rows[0].snippets[1].byte_pos == 5 and rows[0].snippets[1].path == "body"


def test_persist_and_recover(spark, tmp_path):
    e = SearchEngine(spark, path=str(tmp_path / "t"), clock=lambda: 10_000)
    e.set_schema(EMAIL)
    put(spark, e, [mail("a", "one", "puppy")])
    e.persist()
    again = SearchEngine(spark, path=str(tmp_path / "t"), clock=lambda: 10_000)
    assert again.initialize()["num_documents"] == 1
    assert again.get_schema() == EMAIL and uris(again.search(SearchSpec("puppy"))) == ["a"]
    again.reset()
    assert SearchEngine(spark, path=str(tmp_path / "t")).initialize()["num_documents"] == 0


def test_put_stream(spark, tmp_path):
    from siftline.streaming.ingest import put_stream

    e = SearchEngine(spark, clock=lambda: 10_000)
    e.set_schema(EMAIL)
    kind = "namespace string, uri string, schema string, score int, creation_ts_ms long, ttl_ms long, props struct<body:array<string>,subject:array<string>>"
    spark.createDataFrame([mail("a", "s", "old")], kind).write.parquet(str(tmp_path / "in"))
    put_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), e, str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([mail("a", "s", "new")], kind).write.mode("append").parquet(str(tmp_path / "in"))
    put_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), e, str(tmp_path / "ck")).awaitTermination()
    assert e.get("ns", "a")["props"]["body"] == ["new"]


def test_schema_rules():
    ok = lambda *p: schema.validate(Schema((Type("T", p),)))
    ok(email_prop("a"))
    for bad, code in [((email_prop("a"), email_prop("a")), "ALREADY_EXISTS"), ((email_prop("a-b"),), "INVALID_ARGUMENT"), ((Property("a", "x"),), "INVALID_ARGUMENT"), ((Property("a", "string", match="exact"),), "INVALID_ARGUMENT"), ((Property("a", "document", schema_type="T"),), "INVALID_ARGUMENT"), ((Property("a", "document", schema_type="U"),), "INVALID_ARGUMENT")]:
        with pytest.raises(SchemaError) as err:
            ok(*bad)
        assert err.value.code == code
    with pytest.raises(SchemaError) as err:
        ok(*(email_prop(f"p{i}") for i in range(17)))
    assert err.value.code == "OUT_OF_RANGE"
    person = Type("Person", (email_prop("name"), email_prop("emailAddress")))
    full = Schema((Type("Email", (email_prop("body"), email_prop("subject"), Property("sender", "document", schema_type="Person", index_nested=True))), person))
    assert [s.path for s in schema.sections(full) if s.schema == "Email"] == ["body", "sender.emailAddress", "sender.name", "subject"]
    less = Schema((full.types[0], Type("Person", (email_prop("name"),))))
    d = schema.compare(full, less)
    assert d.incompatible == {"Person", "Email"} and d.index_incompatible == {"Person", "Email"}
    assert schema.compare(full, Schema((person,))).deleted == {"Email"}


def test_small_parts():
    assert tree(["a", "a.b", "c"]) == {"a": {"b": {}}, "c": {}}
    c = rank.Cursors(budget=10, seed=1)

    class Frame:
        def unpersist(self):
            pass

    t1, t2 = c.add(Frame(), 8, 3), c.add(Frame(), 8, 3)
    assert t1 and t2 and t1 not in c.held and t2 in c.held and c.add(Frame(), 3, 3) == 0
    text = "one two three four five"
    lo, hi = snippet.window(text, snippet.spans(text), 2, 13)
    assert text[lo:hi] == "one two three"
    assert snippet.find([("p", "日本 foo 🙂 foo")], [("foo", False)], 9, 0)[1][1:5] == (16, 3, 10, 3)
    assert snippet.walk({"a": [{"b": ["x"]}, {"b": ["y", "z"]}]}, "a.b") == [("a[0].b", "x"), ("a[1].b[0]", "y"), ("a[1].b[1]", "z")]
    assert str(Term("a", "p.q")) == "p.q:a"


@pytest.mark.parametrize(
    "text, word, size, want",
    [
        ("foo bar baz", "bar", 3, "bar"), ("foo bar baz", "bar", 11, "foo bar baz"), ("foo baar baz", "baar", 4, "baar"), ("foo baar baz", "baar", 12, "foo baar baz"),
        ("a bar b", "bar", 6, "a bar"), ("a bar b", "bar", 5, "bar b"), ("a baar b", "baar", 7, "baar b"), ("a baar b", "baar", 6, "baar b"),
        ("one two three four", "one", 9, "one two"), ("one two three four", "four", 11, "three four"), ("one two, three", "one", 8, "one two,"), ("word", "word", 3, ""),
    ],
)
def test_window_cases(text, word, size, want):
    """Matches and windows of odd and even length; room that one side has not goes to the other."""
    toks = snippet.spans(text)
    lo, hi = snippet.window(text, toks, [text[a:b] for a, b in toks].index(word), size)
    assert hi - lo <= size and text[lo:hi] == want


USAGE = "namespace string, uri string, usage_timestamp_ms long, usage_type int"


def test_usage_stays_with_a_key_until_it_is_deleted(spark, tmp_path):
    e = SearchEngine(spark, path=str(tmp_path / "t"), clock=lambda: 10_000)
    e.set_schema(EMAIL)
    put(spark, e, [mail("a", "t", "word"), mail("b", "t", "word")])
    e.report_usage(spark.createDataFrame([("ns", "a", 5000, 1), ("ns", "b", 5000, 1), ("ns", "b", 6000, 1)], USAGE))
    score = lambda: {r.uri: r.score for r in e.search(SearchSpec("word", rank_by="usage_type1_count")).rows.collect()}
    put(spark, e, [mail("a", "t", "word again")])
    assert score() == {"a": 1.0, "b": 2.0}
    e.delete("ns", "b")
    put(spark, e, [mail("b", "t", "word anew")])
    assert score() == {"a": 1.0, "b": 0.0}
    e.persist()
    e.report_usage(spark.createDataFrame([("ns", "a", 7000, 1)], USAGE))
    e.persist(full=False)  # documents only; what the session knows of usage stays
    assert score() == {"a": 2.0, "b": 0.0}
    again = SearchEngine(spark, path=str(tmp_path / "t"), clock=lambda: 10_000)
    assert again.initialize() == {"status": "OK", "num_documents": 4, "num_schema_types": 1} and again.usage.count() == 1


def test_puts_are_indexed_as_deltas(spark, tmp_path, monkeypatch):
    from siftline import engine as module

    monkeypatch.setattr(module, "MOST_DELTAS", 2)
    for path in (None, str(tmp_path / "t")):
        e = SearchEngine(spark, path=path, clock=lambda: 10_000)
        e.set_schema(EMAIL)
        seen = []
        for i in range(5):
            put(spark, e, [mail(f"d{i}", "s", f"word w{i}"), mail("same", "s", f"word v{i}")])
            assert sorted(uris(e.search(SearchSpec("word")))) == sorted([*(f"d{k}" for k in range(i + 1)), "same"])
            seen.append(e.deltas)
        assert seen == [0, 1, 2, 0, 1]
        assert uris(e.search(SearchSpec("v3"))) == [] and uris(e.search(SearchSpec("v4"))) == ["same"]
        deltas = {r.uri: r.score for r in e.search(SearchSpec("word", rank_by="relevance")).rows.collect()}
        e._forget_index()
        whole = {r.uri: r.score for r in e.search(SearchSpec("word", rank_by="relevance")).rows.collect()}
        assert deltas == pytest.approx(whole)


def test_a_torn_state_falls_back_to_the_one_before(spark, tmp_path):
    at = str(tmp_path / "t")
    e = SearchEngine(spark, path=at, clock=lambda: 10_000)
    e.set_schema(EMAIL)
    put(spark, e, [mail("a", "t", "one")])
    e.persist()
    put(spark, e, [mail("b", "t", "two")])
    e.persist()
    last = sorted((tmp_path / "t").glob("state-*"))[-1]
    last.write_text(last.read_text()[:-3])
    again = SearchEngine(spark, path=at, clock=lambda: 10_000)
    got = again.initialize()
    assert got["status"] == "WARNING_DATA_LOSS" and got["num_documents"] == 1 and uris(again.search(SearchSpec("one"))) == ["a"]


def test_usage_stream(spark, tmp_path):
    from siftline.streaming.ingest import usage_stream

    spark.createDataFrame([("n", "a", 5500, 1), ("n", "a", 1000, 1), ("n", "a", 2000, 2)], USAGE).write.parquet(str(tmp_path / "in"))
    q = usage_stream(spark.readStream.schema(USAGE).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("used").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("used").first()
    assert (r.cnt1, r.last1_s, r.cnt2, r.last2_s, r.cnt3) == (2, 5, 1, 2, 0)
