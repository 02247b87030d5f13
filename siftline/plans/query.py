"""The query language: tokens by a small state machine, then an AST. Driver-side; queries are short."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from siftline.functions.text import normalize_term

MAX_QUERY_BYTES = 23_000
_L, _N = r"[^\W\d_]", r"\d"
_SEGMENT = re.compile(rf"(?:\w*(?:{_L}(?:[.:'’]{_L})+|{_N}(?:[.,;']{_N})+))+\w*|\w+|[$+<=>^`|~]|\s+|.", re.S)


class QueryError(ValueError):
    """The query is not well formed."""


@dataclass(frozen=True)
class Term:
    text: str
    path: str | None = None

    def __str__(self) -> str:
        return f"{self.path}:{self.text}" if self.path else self.text


@dataclass(frozen=True)
class All:
    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Not:
    child: object

    def __str__(self) -> str:
        return f"(NOT {self.child})"


@dataclass(frozen=True)
class And:
    parts: tuple

    def __str__(self) -> str:
        return "(" + " AND ".join(map(str, self.parts)) + ")"


@dataclass(frozen=True)
class Or:
    parts: tuple

    def __str__(self) -> str:
        return "(" + " OR ".join(map(str, self.parts)) + ")"


ERRORS = {
    "ws": "No whitespaces before or after OR operator", "exclgroup": "Exclusion on groups is not supported", "exclor": "Exclusion and OR operators can't be used together",
    "exclprop": "Exclusion and property restriction operators can't be used together", "propgroup": "Property restriction on groups is not supported",
    "propor": "Property restriction and OR operators can't be used together", "groupprop": "Property restriction on groups is not supported", "nonascii": "Characters in property name must all be ASCII.",
}
CLASSES = ("ws", "A", "U", "(", ")", "-", "OR", ":", "other")
#: For each state: what to do on each class. A digit is the next state; O emits what is held, I drops it, K keeps it, C appends.
STATES = {
    0: "0I 1I 9I 7I 8I 2I 6I 0I 0I", 1: "0O 1O 9O 7O 8O 0O E.ws 4K 0O", 2: "0I 3O 3O E.exclgroup 8I 2I E.exclor E.exclprop 0I", 3: "0O 1O 9O 7O 8O 0O E.ws E.exclprop 0O",
    4: "0O 5O 5O E.propgroup 8O E.exclprop E.propor 4K 0O", 5: "0O 1O 9O 7O 8O 0O E.ws 10C 0O", 6: "0O E.ws E.ws 7O 8I E.ws E.ws E.ws 0O", 7: "0O 1O 9O 7O 8O 2O 7K 0O 0O",
    8: "0O 1O 9O 7O 8O 2O 6O E.groupprop 0O", 9: "0O 1O 9O 7O 8O 0O E.ws E.nonascii 0O", 10: "0O 10C 10C 7O 8O 0O E.ws 10C 0O",
}


def segments(text: str) -> list[str]:
    return [s for s in _SEGMENT.findall(text) if not s.isspace()]


def _class(s: str) -> str:
    if not s.isascii():
        return "U" if unicodedata.category(s[0])[0] in "LNM" else "other"
    return "A" if s[0].isalnum() else "other"


def _scan(query: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(query):
        c = query[i]
        if c == " ":
            while i < len(query) and query[i] == " ":
                i += 1
            out.append(("ws", " "))
        elif c in "()-:":
            out.append((c, c))
            i += 1
        elif query.startswith("OR", i):
            out.append(("OR", "OR"))
            i += 2
        else:
            j = i
            while j < len(query) and query[j] not in "()-: ":
                j += 1
            out += [(_class(s), s) for s in _SEGMENT.findall(query[i:j])]
            i = j
    return [*out, ("ws", " ")]


def lex(query: str) -> list[tuple[str, str]]:
    """Tokens: R a term, P a property path, X exclusion, OR, ( and )."""
    out: list[tuple[str, str]] = []
    state, held = 0, None

    def emit(new: int) -> None:
        if held is None:
            return
        kind, text = held
        if state == 10:
            out.extend(("R", s) for s in segments(text) if _class(s) != "other")
        elif kind in ("A", "U"):
            out.append(("P" if new == 5 else "R", text))
        elif kind == "-":
            out.append(("X", "-"))
        elif kind == "(":
            out.append(("(", "("))
        elif kind == ")":
            if out and out[-1][0] == "OR":
                out.pop()
            out.append((")", ")"))
        elif kind == "OR" and out and out[-1][0] in ("R", ")"):
            out.append(("OR", "OR"))

    for kind, text in _scan(query):
        do = STATES[state].split()[CLASSES.index(kind)]
        if do[0] == "E":
            raise QueryError(ERRORS[do[2:]])
        new, act = int(do[:-1]), do[-1]
        if act == "O":
            emit(new)
        if act in "OI":
            held = (kind, text)
        elif act == "C":
            held = (held[0], held[1] + text)
        state = new
    if out and out[-1][0] == "OR":
        out.pop()
    depth = 0
    for kind, _ in out:
        depth += (kind == "(") - (kind == ")")
        if depth < 0:
            raise QueryError("Too many right parentheses")
    if depth:
        raise QueryError("Unbalanced left and right parentheses")
    return out


def parse(query: str):
    """The AST of a query; OR binds tighter than AND, and a term before OR joins an open run of alternatives."""
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise QueryError(f"query is longer than {MAX_QUERY_BYTES} bytes")
    toks = lex(query)
    at = 0

    def group():
        nonlocal at
        ands, ors, after_or = [], [], False
        while at < len(toks) and toks[at][0] != ")":
            kind, text = toks[at]
            at += 1
            if kind == "OR":
                after_or = True
                continue
            if kind == "(":
                item = group()
                at += 1
            elif kind == "X":
                item = Not(Term(normalize_term(toks[at][1])))
                at += 1
            elif kind == "P":
                item = Term(normalize_term(toks[at][1]), text)
                at += 1
            else:
                item = Term(normalize_term(text))
            if after_or or (at < len(toks) and toks[at][0] == "OR"):
                ors.append(item)
            else:
                if ors:
                    ands.append(Or(tuple(ors)) if len(ors) > 1 else ors[0])
                    ors = []
                ands.append(item)
            after_or = False
        if ors:
            ands.append(Or(tuple(ors)) if len(ors) > 1 else ors[0])
        return All() if not ands else ands[0] if len(ands) == 1 else And(tuple(ands))

    return group()


def leaves(node) -> list[Term]:
    """Distinct terms in the order they stand."""
    if isinstance(node, Term):
        return [node]
    kids = node.parts if isinstance(node, (And, Or)) else (node.child,) if isinstance(node, Not) else ()
    return list(dict.fromkeys(x for k in kids for x in leaves(k)))


def holds(node, have) -> bool:
    """The query's truth for one document; `have` says whether a Term matches. For tests and explanations."""
    if isinstance(node, Term):
        return have(node)
    if isinstance(node, Not):
        return not holds(node.child, have)
    if isinstance(node, And):
        return all(holds(p, have) for p in node.parts)
    if isinstance(node, Or):
        return any(holds(p, have) for p in node.parts)
    return True
