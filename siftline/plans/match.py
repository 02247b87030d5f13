"""A query's AST as one pass over the postings: filter to its terms, collapse per document, test the tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.plans.query import All, And, Not, Or, Term, leaves

TF_CAP = 255


def term_condition(t: Term, prefix: bool, restrict: bool = True) -> Column:
    """Exact, or prefix within prefix sections; `path:` asks for exactly that section path."""
    c = F.col("term") == t.text
    if prefix:
        c = c | (F.col("term").startswith(t.text) & F.col("in_prefix_section"))
    return c & (F.col("path") == t.path) if restrict and t.path else c


def truth(node, marks: dict[Term, Column]) -> Column:
    if isinstance(node, Term):
        return marks[node]
    if isinstance(node, Not):
        return ~truth(node.child, marks)
    if isinstance(node, And):
        return reduce(lambda a, b: a & b, [truth(p, marks) for p in node.parts])
    if isinstance(node, Or):
        return reduce(lambda a, b: a | b, [truth(p, marks) for p in node.parts])
    return F.lit(True)


def can_hold_without_terms(node) -> bool:
    if isinstance(node, Term):
        return False
    if isinstance(node, And):
        return all(map(can_hold_without_terms, node.parts))
    if isinstance(node, Or):
        return any(map(can_hold_without_terms, node.parts))
    return True if isinstance(node, All) else not _always(node.child)


def _always(node) -> bool:
    return isinstance(node, All)


def active(node, marks: dict[Term, Column], above: Column | None = None) -> list[tuple[Term, Column]]:
    """(leaf, whether it contributes) in query order: every subtree around it must hold; excluded terms never do."""
    above = F.lit(True) if above is None else above
    if isinstance(node, Term):
        return [(node, above & marks[node])]
    if isinstance(node, (And, Or)):
        here = above & truth(node, marks)
        return [x for p in node.parts for x in active(p, marks, here)]
    return []


def term_hits(postings: DataFrame, node, prefix: bool = False) -> DataFrame:
    """One row per document that holds any term of the query: m{i}, f{i} per leaf, a{i} per distinct text, mask, hit mask."""
    ls = leaves(node)
    texts = list(dict.fromkeys(t.text for t in ls))
    any_c = [term_condition(Term(x), prefix, False) for x in texts]
    own = [term_condition(t, prefix) for t in ls]
    rows = postings.where(reduce(lambda a, b: a | b, any_c))
    cap = lambda c: F.least(F.coalesce(F.sum(F.when(c, F.col("tf"))), F.lit(0)), F.lit(TF_CAP))
    per_section = rows.groupBy("doc_id", "section_id").agg(
        *[cap(c).alias(f"f{i}") for i, c in enumerate(own)], *[F.max(c).alias(f"a{i}") for i, c in enumerate(any_c)], F.max(reduce(lambda a, b: a | b, own)).alias("own"),
    )
    bit = F.expr("shiftleft(1, section_id)")
    return per_section.groupBy("doc_id").agg(
        *[F.coalesce(F.sum(f"f{i}"), F.lit(0)).alias(f"f{i}") for i in range(len(ls))], *[F.max(f"a{i}").alias(f"a{i}") for i in range(len(texts))],
        F.bit_or(bit).alias("mask"), F.coalesce(F.bit_and(F.when(F.col("own"), bit)), F.lit(0)).alias("intersect_mask"),
    )


def match(postings: DataFrame, docs: DataFrame, node, prefix: bool = False) -> DataFrame:
    """Documents of `docs` (already filtered) for which the query holds, with the columns of term_hits."""
    ls = leaves(node)
    if not ls:
        return docs.withColumn("mask", F.lit(0)).withColumn("intersect_mask", F.lit(0))
    hits = term_hits(postings, node, prefix)
    joined = docs.join(hits, "doc_id", "left" if can_hold_without_terms(node) else "inner")
    marks = {t: F.coalesce(F.col(f"f{i}") > 0, F.lit(False)) for i, t in enumerate(ls)}
    return joined.where(truth(node, marks)).withColumn("mask", F.coalesce("mask", F.lit(0))).withColumn("intersect_mask", F.coalesce("intersect_mask", F.lit(0)))
