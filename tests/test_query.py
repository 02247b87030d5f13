import random

import pytest

from siftline.plans import match, query
from siftline.plans.query import All, And, Not, Or, QueryError, Term


def toks(q):
    return [(k, t) if k in "RP" else k for k, t in query.lex(q)]


@pytest.mark.parametrize(
    "q, want",
    [
        ("-term1", ["X", ("R", "term1")]), ("- term1", [("R", "term1")]), ("term1- term2", [("R", "term1"), ("R", "term2")]), ("--term1", ["X", ("R", "term1")]), ("-term1-term2", ["X", ("R", "term1"), ("R", "term2")]),
        ("email.title:hello", [("P", "email.title"), ("R", "hello")]), (":term1", [("R", "term1")]), ("term1:", [("R", "term1")]), ("property:foo:bar", [("P", "property"), ("R", "foo:bar")]),
        ("property1:term1:term2", [("P", "property1"), ("R", "term1"), ("R", "term2")]), ("property1::term1", [("P", "property1"), ("R", "term1")]), ("term1 OR OR term2", None), ("OR term1", [("R", "term1")]),
        ("term1 OR", [("R", "term1")]), ("( OR )", ["(", ")"]), ("term1 OR(term2)", [("R", "term1"), "OR", "(", ("R", "term2"), ")"]), ("(term1)(term2)", ["(", ("R", "term1"), ")", "(", ("R", "term2"), ")"]), ("", []),
    ],
)
def test_lex(q, want):
    if want is None:
        with pytest.raises(QueryError):
            query.lex("term1 ORterm2")
    else:
        assert toks(q) == want


@pytest.mark.parametrize("q", ["-(term1)", "-OR", "-property1:term1", "property1:-term1", "property1:(term1)", "property1:OR", "term1 OR-term2", "term1 OR:term2", "(a", "a)", "((a)"])
def test_errors(q):
    with pytest.raises(QueryError):
        query.parse(q)


def test_trees():
    a, b, c, d, e = map(Term, "abcde")
    assert query.parse("a b OR c d") == And((a, Or((b, c)), d))
    assert query.parse("a OR b c OR d") == Or((a, b, c, d))
    assert query.parse("a OR b c d OR e") == And((Or((a, b)), c, Or((d, e))))
    assert query.parse("") == All() and query.parse("()") == All()
    assert query.parse("Éa -b") == And((Term("ea"), Not(b)))
    assert query.parse("p.q:a (b OR c)") == And((Term("a", "p.q"), Or((b, c))))


def test_plans_agree_with_the_tree(spark):
    rng = random.Random(0)
    words = list("abcd")
    docs = {i: {w for w in words if rng.random() < 0.45} for i in range(40)}
    posts = spark.createDataFrame([(w, i, 0, "p", 1, True) for i, ws in docs.items() for w in ws], "term string, doc_id long, section_id int, path string, tf int, in_prefix_section boolean").cache()
    ids = spark.createDataFrame([(i,) for i in docs], "doc_id long").cache()

    def tree(depth):
        k = rng.randint(0, 3 if depth else 0)
        if k == 0:
            return Term(rng.choice(words))
        if k == 1:
            return Not(Term(rng.choice(words)))
        return (And if k == 2 else Or)(tuple(tree(depth - 1) for _ in range(rng.randint(2, 3))))

    for _ in range(8):
        node = tree(2)
        want = {i for i, ws in docs.items() if query.holds(node, lambda t: t.text in ws)}
        assert {r.doc_id for r in match.match(posts, ids, node).collect()} == want, str(node)
