"""Personal data by weak supervision, in DataFrame functions only.

Four base kinds (email, ip, card, phone) are fixed by their patterns and always kept. Further candidates
(phone numbers without a country code, identity numbers, credentials, long digit runs that fail the
checksum) are judged: labelers of three sorts (pattern, gazetteer, context) vote on every candidate,
expectation-maximisation over the counts of vote patterns (at most 2^5 x 7, whatever the corpus) estimates each
labeler's reliability, and a logistic span classifier is trained on the posteriors. Candidates that it
accepts and that touch no base span are added.

The patterns use possessive repeats and look-behinds: same leftmost, non-overlapping matches as the plain
forms, without backtracking, so texts of any length take linear time.

Defined results: null and empty texts have no span; offsets are code points; repeated rows are each
returned; an empty table gives no row; extra columns are kept by find() and redact().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_columns, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "local_phone", "id_number", "credential")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "credential": r"AKIA[0-9A-Z]{16}|(?:password|passwd|token|secret|api_key)\x20?[=:]\x20?\"?[A-Za-z0-9]{12,64}",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
CUES = r"(?:mail|phone|tel|call|fax|mobile|card|visa|credit|ip|host|server|address|login|password|token|secret|key|contact)[\s:=#\"(]*$"
AGAINST = r"(?:version|section|chapter|page|figure|licen[cs]e|cc by[a-z-]*)[\s,:]*$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """The rule a match of a base kind must pass."""
    n = F.char_length(_digits(m))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _votes(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    n, size = F.char_length(_digits(m)), F.char_length(m)
    gazetteer = {
        "email": m.rlike(r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"), "card": m.rlike("^[3-6]"), "phone": m.rlike(r"^\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9])"),
        "ip": m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."), "credential": m.rlike("^(?:AKIA|pass|token|secret|api)"),
    }.get(kind, F.lit(False))
    shape = {"email": size.between(6, 80), "ip": size.between(7, 15), "card": n.between(15, 16), "phone": n.between(11, 13), "credential": m.rlike("[0-9]") & m.rlike("[A-Za-z]")}.get(kind, F.lit(True))
    return [
        valid(kind, m) if kind in KINDS else F.lit(kind != "local_phone"),
        gazetteer | before.rlike(CUES),
        before.rlike(r"(?:^|[\s\"'(<,;:=])$") & after.rlike(r"^(?:$|[^A-Za-z0-9])"),
        shape,
        ~before.rlike(AGAINST),
    ]


N_VOTES = 5


def _found(text: Column, kind: str) -> Column:
    """array<struct<start, size, m>> of a pattern's matches: lengths of the pieces between them add up to offsets."""
    rx = PATTERNS[kind]
    m = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    pieces = F.split(text, rx, -1)
    both = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(m)).alias("p"), m.alias("m"))
    kind_of = "array<struct<start:int,size:int,m:string>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(kind_of).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin, size = acc["at"] + F.char_length(x["p"]), F.char_length(x["m"])
        one = F.array(F.struct(begin.alias("start"), size.alias("size"), x["m"].alias("m")))
        return F.struct((begin + size).alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(kind_of)), one).alias("out"))

    got = F.coalesce(F.aggregate(both, start, add, lambda a: a["out"]), F.array().cast(kind_of))
    may = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(may & text.rlike(rx), got).otherwise(F.array().cast(kind_of))


def candidates(text: Column) -> Column:
    """array<struct<kind, start, stop, base, votes>>; votes: a bit for each labeler."""

    def judge_of(k: int, kind: str):
        def judge(x: Column) -> Column:
            before = F.lower(F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24))))
            after = F.substring(text, x["start"] + x["size"] + 1, F.lit(1))
            bits = [F.when(v, F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(_votes(kind, x["m"], before, after))]
            base = valid(kind, x["m"]) if kind in KINDS else F.lit(False)
            return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), (x["start"] + x["size"]).alias("stop"), base.alias("base"), sum(bits[1:], bits[0]).alias("votes"))

        return judge

    return F.concat(*(F.transform(_found(text, kind), judge_of(k, kind)) for k, kind in enumerate(ALL)))


def label_model(counts: dict[tuple[int, int], int], rounds: int = 60) -> tuple[dict[tuple[int, int], float], list[float], list[float]]:
    """EM over vote-pattern counts: (posterior by pattern, how often each labeler votes on true and on false spans)."""
    total = sum(counts.values()) or 1
    post = {p: 0.95 if p[1] & 1 and bin(p[1]).count("1") >= 3 else 0.05 + 0.1 * bin(p[1]).count("1") for p in counts}
    hit, false = [0.5] * N_VOTES, [0.5] * N_VOTES
    for _ in range(rounds):
        yes = sum(counts[p] * post[p] for p in counts)
        for i in range(N_VOTES):
            on = [p for p in counts if p[1] >> i & 1]
            hit[i] = (sum(counts[p] * post[p] for p in on) + 1) / (yes + 2)
            false[i] = (sum(counts[p] * (1 - post[p]) for p in on) + 1) / (total - yes + 2)
        prior = (yes + 1) / (total + 2)
        for p in counts:
            z = math.log(prior / (1 - prior))
            for i in range(N_VOTES):
                z += math.log(hit[i] / false[i]) if p[1] >> i & 1 else math.log((1 - hit[i]) / (1 - false[i]))
            post[p] = 1 / (1 + math.exp(-max(-30, min(30, z))))
    return post, hit, false


def span_classifier(counts: dict[tuple[int, int], int], post: dict[tuple[int, int], float], rounds: int = 300, decay: float = 1e-3) -> list[float]:
    """Logistic weights (votes, kinds, constant) fitted to the posteriors."""
    width = N_VOTES + len(ALL) + 1
    w, total = [0.0] * width, sum(counts.values()) or 1
    rows = [([float(p[1] >> i & 1) for i in range(N_VOTES)] + [float(p[0] == k) for k in range(len(ALL))] + [1.0], counts[p] / total, post[p]) for p in counts]
    for _ in range(rounds):
        g = [decay * x for x in w]
        for x, share, y in rows:
            miss = share * (1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x)))))) - y)
            g = [a + miss * b for a, b in zip(g, x)]
        w = [a - 1.0 * b for a, b in zip(w, g)]
    return w


def find(docs: DataFrame, keep: Column, text_col: str = "text") -> DataFrame:
    """kept (the column `keep`), _base and _spans: array<struct<start, kind, stop>> in order of start, then kind."""
    spotted = materialize(docs.select(keep.alias("kept"), candidates(text_or_empty(text_col)).alias("_cand")), "pii")
    seen = spotted.select(F.explode("_cand").alias("c")).groupBy("c.kind", "c.votes").count().collect()  # at most 7 x 32 rows
    counts = {(r[0], r[1]): r[2] for r in seen}
    post, _, _ = label_model(counts)
    w = span_classifier(counts, post)
    z = lambda c: sum((F.when(c["votes"].bitwiseAND(F.lit(1 << i)) != 0, F.lit(w[i])).otherwise(F.lit(0.0)) for i in range(N_VOTES)), F.lit(w[-1])) + F.element_at(F.array(*map(F.lit, w[N_VOTES:-1])), c["kind"] + 1)
    base = F.filter("_cand", lambda c: c["base"])
    apart = lambda c: ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    more = F.filter("_cand", lambda c: ~c["base"] & (z(c) >= 0) & apart(c))
    order = lambda a: F.array_sort(F.transform(a, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"))))
    return spotted.withColumns({"_base": order(base), "_spans": order(F.concat(base, more))}).drop("_cand")


def _joined(spans: str) -> Column:
    name = F.array(*map(F.lit, ALL))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    got = find(docs, F.col(id_col).cast("long"), text_col).withColumnRenamed("kept", "doc_id")
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    n = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return got.select("doc_id", *n, F.sha2(_joined("_base").cast("binary"), 256).alias("base_sha256"), _joined("_spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns; each found span of the text is replaced by its kind in angle brackets. Null texts stay null."""
    got = find(docs, F.struct(*own_columns(docs)), text_col)  # one struct: no name of a column can clash
    name = F.array(*(F.lit(f"<{k.upper()}>") for k in ALL))
    text = F.col(f"kept.`{text_col}`")

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(name, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_spans", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    new = F.when(F.size("_spans") > 0, clean).otherwise(text)
    return got.select(*((new if c == text_col else F.col(f"kept.`{c}`")).alias(c) for c in docs.columns))
