"""Tokens and normal forms as Column expressions; all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word breaks: letters joined by . : ' ’ , digits joined by . , ; ' , underscores, and sign tokens.
#: No look-around, so Java and RE2 agree.
RX = r"(?:[\p{L}\p{M}\p{N}_]*(?:[\p{L}\p{M}](?:[.:'’][\p{L}\p{M}])+|\p{N}(?:[.,;']\p{N})+))+[\p{L}\p{M}\p{N}_]*|[\p{L}\p{M}\p{N}_]+|[$+<=>^`|~]"
#: The same tokens for Java alone, without a step back: runs of letters, digits or underscores, a sign between two of a kind.
_L, _N = r"[a-z\p{L}\p{M}]++", r"[0-9\p{N}]++"
JAVA_RX = rf"(?:{_L}(?:[.:'’]{_L})*+|{_N}(?:[.,;']{_N})*+|_++)++|[$+<=>^`|~]"
FROM = "áàâäãåāăąçćčĉċďđéèêëēĕėęěğĝġģĥíìîïĩīĭįĵķĺļľłñńņňóòôöõōŏőŕŗřśŝşšţťúùûüũūŭůűųŵýÿŷźżž"
TO = "aaaaaaaaacccccddeeeeeeeeegggghiiiiiiiijklll" + "lnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
#: Full-width signs and letters to ASCII, hiragana to katakana.
WIDE_FROM = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "".join(chr(c) for c in range(0x3041, 0x3097))
WIDE_TO = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))
MAX_TOKEN_BYTES, MAX_TOKENS = 30, 13_107
assert len(FROM) == len(TO) and len(WIDE_FROM) == len(WIDE_TO)


def normalize_latin(c: Column) -> Column:
    """Lower case without diacritics; ß stays."""
    return F.translate(F.lower(c), FROM, TO)


def normalize_map(c: Column) -> Column:
    """ASCII lower case and a character table; other characters stay as they are."""
    return F.translate(F.translate(c, WIDE_FROM, WIDE_TO), "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + FROM + FROM.upper(), "abcdefghijklmnopqrstuvwxyz" + TO + TO)


def normalize_none(c: Column) -> Column:
    return c


NORMALIZERS = {"latin": normalize_latin, "map": normalize_map, "none": normalize_none}


def cut_bytes(c: Column, n: int = MAX_TOKEN_BYTES) -> Column:
    """The longest run of whole characters of at most n bytes from the start."""
    fits = F.filter(F.transform(F.sequence(F.lit(n), F.lit(max(1, n // 4)), F.lit(-1)), lambda i: F.left(c, i)), lambda s: F.octet_length(s) <= n)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.element_at(fits, 1))


def tokens(c: Column) -> Column:
    """Word and sign tokens of a text, in order; what starts with an underscore is punctuation."""
    return F.filter(F.regexp_extract_all(c, F.lit(JAVA_RX), F.lit(0)), lambda t: ~t.startswith("_"))


TOKENIZERS = {"plain": tokens, "verbatim": lambda c: F.array(c)}


def terms(c: Column, normalizer: str = "latin", tokenizer: str = "plain") -> Column:
    """Normalised, cut tokens of a text; null gives none."""
    norm = NORMALIZERS[normalizer](c)
    return F.coalesce(F.transform(TOKENIZERS[tokenizer](norm), lambda t: cut_bytes(t)), F.array().cast("array<string>"))


def normalize_term(t: str) -> str:
    """normalize_latin and cut_bytes for one query term, on the driver."""
    out = t.lower().translate(str.maketrans(FROM, TO))
    return out if len(out.encode()) <= MAX_TOKEN_BYTES else out.encode()[:MAX_TOKEN_BYTES].decode("utf-8", "ignore")


def is_punctuation(c: Column) -> Column:
    return c.rlike(r"^\p{P}")


def is_space(c: Column) -> Column:
    return c.rlike(r"^\p{IsWhite_Space}")


def is_alphabetic(c: Column) -> Column:
    return c.rlike(r"^\p{L}")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def utf16_length(c: Column) -> Column:
    """Code units: astral characters (four bytes in UTF-8) count twice."""
    return F.char_length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def has_bit(mask: Column, bit: Column | int) -> Column:
    return F.shiftleft(F.lit(1), bit).bitwiseAND(mask) != 0 if isinstance(bit, int) else F.expr("1").bitwiseAND(F.call_function("shiftright", mask, bit)) != 0


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def checksum(c: Column) -> Column:
    return F.crc32(c.cast("binary"))
