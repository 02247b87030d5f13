"""Schemas: validation, comparison, sections, row validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALARS = {"string": T.StringType(), "int64": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "bytes": T.BinaryType()}
RANK = {"repeated": 1, "optional": 2, "required": 3}
MAX_SECTIONS = 16


class SchemaError(ValueError):
    code = "INVALID_ARGUMENT"

    def __init__(self, message: str, code: str = "INVALID_ARGUMENT"):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Property:
    name: str
    data_type: str
    cardinality: str = "optional"
    match: str | None = None  # exact or prefix: indexed
    tokenizer: str | None = None
    schema_type: str | None = None
    index_nested: bool = False


@dataclass(frozen=True)
class Type:
    name: str
    properties: tuple[Property, ...] = ()
    version: int = 0


@dataclass(frozen=True)
class Section:
    schema: str
    section_id: int
    path: str
    match: str
    tokenizer: str


@dataclass(frozen=True)
class Schema:
    types: tuple[Type, ...] = ()

    def __getitem__(self, name: str) -> Type:
        for t in self.types:
            if t.name == name:
                return t
        raise SchemaError(f"Schema type '{name}' not found", "NOT_FOUND")

    def names(self) -> list[str]:
        return [t.name for t in self.types]


def email_prop(name: str, match: str | None = "prefix", cardinality: str = "optional") -> Property:
    """An indexed text property."""
    return Property(name, "string", cardinality, match, "plain" if match else None)


def parents(schema: Schema) -> dict[str, set[str]]:
    """For each type, every type that nests it at any depth; recursion is an error."""
    kids = {t.name: {p.schema_type for p in t.properties if p.data_type == "document"} for t in schema.types}
    out: dict[str, set[str]] = {t.name: set() for t in schema.types}

    def walk(top: str, at: str, trail: tuple[str, ...]) -> None:
        for k in kids.get(at, ()):
            if k in trail:
                raise SchemaError(f"Invalid cycle detected in type configs: '{k}'")
            if k not in kids:
                raise SchemaError(f"Undefined 'schema_type': '{k}'")
            out[k].add(top)
            walk(top, k, (*trail, k))

    for t in schema.types:
        walk(t.name, t.name, (t.name,))
    return out


def validate(schema: Schema) -> None:
    seen = set()
    for t in schema.types:
        if not t.name:
            raise SchemaError("Field 'schema_type' cannot be empty")
        if t.name in seen:
            raise SchemaError(f"Field 'schema_type' '{t.name}' is already defined", "ALREADY_EXISTS")
        seen.add(t.name)
        names = set()
        for p in t.properties:
            if not p.name or not (p.name.isascii() and p.name.isalnum()):
                raise SchemaError(f"Field 'property_name' '{p.name}' can only contain alphanumeric characters")
            if p.name in names:
                raise SchemaError(f"Field 'property_name' '{p.name}' is already defined in schema '{t.name}'", "ALREADY_EXISTS")
            names.add(p.name)
            if p.data_type not in SCALARS and p.data_type != "document":
                raise SchemaError(f"Field 'data_type' cannot be UNKNOWN for '{t.name}.{p.name}'")
            if p.cardinality not in RANK:
                raise SchemaError(f"Field 'cardinality' cannot be UNKNOWN for '{t.name}.{p.name}'")
            if p.data_type == "document" and not p.schema_type:
                raise SchemaError(f"Field 'schema_type' is required for DOCUMENT '{t.name}.{p.name}'")
            if (p.match is None) != (p.tokenizer is None):
                raise SchemaError(f"match type and tokenizer of '{t.name}.{p.name}' must both be set or both unset")
    parents(schema)
    sections(schema)


def sections(schema: Schema) -> list[Section]:
    """Depth first, properties by name; nested documents only where they are indexed."""
    out = []
    for t in schema.types:
        mine: list[tuple[str, Property]] = []

        def walk(at: Type, prefix: str) -> None:
            for p in sorted(at.properties, key=lambda p: p.name):
                if p.data_type == "document":
                    if p.index_nested:
                        walk(schema[p.schema_type], f"{prefix}{p.name}.")
                elif p.match:
                    mine.append((prefix + p.name, p))

        walk(t, "")
        if len(mine) > MAX_SECTIONS:
            raise SchemaError(f"Too many properties to be indexed in '{t.name}', max number of properties allowed: {MAX_SECTIONS}", "OUT_OF_RANGE")
        out += [Section(t.name, i, path, p.match, p.tokenizer) for i, (path, p) in enumerate(mine)]
    return out


@dataclass
class Delta:
    deleted: set[str] = field(default_factory=set)
    incompatible: set[str] = field(default_factory=set)
    index_incompatible: set[str] = field(default_factory=set)
    changed: set[str] = field(default_factory=set)


def compare(old: Schema, new: Schema) -> Delta:
    """What a change of schema deletes, breaks (types and all that nest them) or must index anew."""
    d, up, by = Delta(), parents(new), {t.name: t for t in new.types}
    for t in old.types:
        if t.name not in by:
            d.deleted.add(t.name)
            continue
        n = {p.name: p for p in by[t.name].properties}
        bad = index = False
        for p in t.properties:
            q = n.get(p.name)
            if q is None:
                bad = True
                index |= bool(p.match) or p.data_type == "document" and p.index_nested
                continue
            bad |= q.data_type != p.data_type or q.schema_type != p.schema_type or RANK[q.cardinality] > RANK[p.cardinality]
            index |= (q.match, q.tokenizer, q.index_nested) != (p.match, p.tokenizer, p.index_nested)
        was = {p.name for p in t.properties if p.cardinality == "required"}
        bad |= bool({p.name for p in n.values() if p.cardinality == "required"} - was)
        index |= sum(1 for p in n.values() if p.match) > sum(1 for p in t.properties if p.match)
        if bad:
            d.incompatible |= {t.name} | up.get(t.name, set())
        if index:
            d.index_incompatible |= {t.name} | up.get(t.name, set())
        if by[t.name] != t:
            d.changed.add(t.name)
    return d


def props_type(schema: Schema, name: str) -> T.StructType:
    """Spark type of a type's properties: each a list, as a property may repeat. Metadata keeps the configuration."""
    fields = []
    for p in schema[name].properties:
        inner = props_type(schema, p.schema_type) if p.data_type == "document" else SCALARS[p.data_type]
        meta = {"cardinality": p.cardinality, "match": p.match or "", "tokenizer": p.tokenizer or "", "index_nested": p.index_nested}
        fields.append(T.StructField(p.name, T.ArrayType(inner), True, meta))
    return T.StructType(fields)


def all_props(schema: Schema) -> T.StructType:
    """One struct that holds the properties of every type; equal names must have equal Spark types."""
    merged: dict[str, T.StructField] = {}
    for t in schema.types:
        for f in props_type(schema, t.name).fields:
            if f.name in merged and merged[f.name].dataType != f.dataType:
                raise SchemaError(f"'{f.name}' has two data types")
            merged.setdefault(f.name, f)
    return T.StructType(list(merged.values()))


def has_path(schema: Schema, type_name: str, path: str) -> bool:
    head, _, rest = path.partition(".")
    for p in schema[type_name].properties:
        if p.name == head:
            return not rest or p.data_type == "document" and has_path(schema, p.schema_type, rest)
    return False


def path_values(path: str, root: str = "props") -> Column:
    """All values of a dotted path, nested lists joined in order."""
    steps = path.split(".")
    c = F.col(f"{root}.{steps[0]}")
    for s in steps[1:]:
        c = F.flatten(F.filter(c[s], lambda x: x.isNotNull()))
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())


def row_error(schema: Schema) -> Column:
    """Null for a valid row, else the error's code and what it is about. Rows: namespace, uri, schema, score, creation_ts_ms, ttl_ms, props."""
    bad = F.when(F.coalesce(F.length("namespace"), F.lit(0)) == 0, "INVALID_ARGUMENT: namespace is empty").when(F.coalesce(F.length("uri"), F.lit(0)) == 0, "INVALID_ARGUMENT: uri is empty")
    bad = bad.when(F.coalesce(F.length("schema"), F.lit(0)) == 0, "INVALID_ARGUMENT: schema is empty").when(~F.col("schema").isin(schema.names() or [""]), "NOT_FOUND: schema type")
    for c in ("score", "creation_ts_ms", "ttl_ms"):
        bad = bad.when(F.col(c) < 0, f"INVALID_ARGUMENT: {c} is negative")
    known = {f.name for f in all_props(schema).fields}
    for t in schema.types:
        own = {p.name: p for p in t.properties}
        for p in own.values():
            n = F.coalesce(F.size(F.col(f"props.{p.name}")), F.lit(0))
            n = F.greatest(n, F.lit(0))
            wrong = {"optional": n > 1, "required": n != 1}.get(p.cardinality)
            if wrong is not None:
                bad = bad.when((F.col("schema") == t.name) & wrong, f"INVALID_ARGUMENT: {t.name}.{p.name} is {p.cardinality}")
        for name in sorted(known - own.keys()):
            bad = bad.when((F.col("schema") == t.name) & (F.size(F.col(f"props.{name}")) > 0), f"NOT_FOUND: {t.name}.{name}")
    return bad

