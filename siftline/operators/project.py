"""Projection by dotted paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WILDCARD = "*"


def tree(paths: list[str]) -> dict:
    """Trie of names. A path below another leaves only the lower one, as the node then has children."""
    root: dict = {}
    for p in paths:
        at = root
        for s in p.split("."):
            at = at.setdefault(s, {})
    return root


def keep(c: Column, kind: T.StructType, node: dict) -> Column:
    """A struct's fields in the tree; a leaf keeps its whole subtree, the others become null."""
    out = []
    for f in kind.fields:
        sub = node.get(f.name)
        value = c[f.name]
        if sub is None:
            value = F.lit(None).cast(f.dataType)
        elif sub and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            value = F.transform(value, _inner(f.dataType.elementType, sub))
        elif sub:
            value = F.lit(None).cast(f.dataType)
        out.append(value.alias(f.name))
    return F.when(c.isNotNull(), F.struct(*out))


def _inner(kind: T.StructType, sub: dict):
    return lambda x: keep(x, kind, sub)


def choose(masks: list[tuple[str, list[str]]], last_wins: bool = False) -> dict[str, dict]:
    """Tree by type; of repeated types a search takes the first mask, a point lookup the last."""
    out: dict[str, dict] = {}
    for name, paths in masks:
        if last_wins or name not in out:
            out[name] = tree(paths)
    return out


def project(rows: DataFrame, masks: list[tuple[str, list[str]]], last_wins: bool = False, root: str = "props") -> DataFrame:
    """Own type's mask, else the wildcard's, else everything."""
    trees = choose(masks, last_wins)
    kind = rows.schema[root].dataType
    other = keep(F.col(root), kind, trees[WILDCARD]) if WILDCARD in trees else F.col(root)
    c = None
    for name, node in trees.items():
        if name != WILDCARD:
            own = keep(F.col(root), kind, node)
            c = F.when(F.col("schema") == name, own) if c is None else c.when(F.col("schema") == name, own)
    return rows.withColumn(root, other if c is None else c.otherwise(other))
