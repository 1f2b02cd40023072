"""Secret scan: an Aho-Corasick keyword prefilter, anchored patterns at its hits, checksums inside tokens.

One pass over the text finds all keywords; patterns are tried only where a keyword starts. Runs of hex
digits have no keyword and are found by their length. Tokens that carry their own checksum are
reported only when it holds.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandwise.llm.columns import fresh, with_struct

#: Kinds in the order in which they are listed at equal starts.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt")

#: The patterns of the base kinds and the shapes of public token formats.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN_MIN, ACCESS_MIN = 6, 20

SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
])
FIELDS = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])


def _assign(buf: bytes, at: int):
    m = ASSIGN.match(buf, at)
    return m and (m.end(), m.end(2) - m.start(2) >= ASSIGN_MIN)


def _access(buf: bytes, at: int):
    m = ACCESS.match(buf, at)
    return m and (m.end(), m.end() - at >= ACCESS_MIN)


def _checked(buf: bytes, at: int):
    m = CHECKED.match(buf, at)
    return m and (m.end(), _base62(zlib.crc32(m[1])) == m[2].decode())


def _jwt(buf: bytes, at: int):
    m = JWT.match(buf, at)
    return m and (m.end(), _is_object(m[1]) and _is_object(m[2]))


#: Keyword in lower case -> its kind and the pattern anchored at the keyword's start.
KEYWORDS: dict[str, tuple[str, Callable]] = {
    **{k: ("assign", _assign) for k in ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": ("access", _access),
    **{k: ("github", _checked) for k in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")},
    "npm_": ("npm", _checked),
    "eyj": ("jwt", _jwt),
}


def _base62(n: int, width: int = 6) -> str:
    digits = ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(width, "0")


def _is_object(part: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):  # nested deeper than a parser goes: no header of a token
        return False


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word in KEYWORDS:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton


def scan(text: bytes | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in bytes, in order; leftmost and not overlapping within a kind.

    A match that fails its length or checksum still uses up its characters.
    """
    if not text:
        return []
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    hits = [(end - len(word) + 1, word) for end, word in automaton.iter(text.lower().decode("latin-1"))]
    used = dict.fromkeys(KINDS, 0)
    for start, word in sorted(hits):
        kind, pattern = KEYWORDS[word]
        if start >= used[kind] and (match := pattern(text, start)):
            used[kind], holds = match
            if holds:
                found.append((start, KINDS.index(kind), used[kind]))
    return sorted(found)


def _code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Byte spans as code point spans."""
    if text.isascii():
        place = int
    else:  # code points that start before each byte
        starts = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
        place = np.concatenate([[0], np.cumsum(starts)]).item
    return [{"kind": KINDS[k], "start": place(a), "end": place(b)} for a, k, b in spans]


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the struct ``out``: ``spans`` (kind, start, end in code points, end exclusive).

    Null and empty texts have no spans. Repeated rows are scanned alike. A column already called
    ``out`` is replaced; other columns stay.
    """

    def make():
        automaton = _automaton()
        return lambda texts: [
            {"spans": _code_points(t, s) if (s := scan(t, automaton)) else []} for t in texts
        ]

    return with_struct(docs, text, out, FIELDS, make, keep)


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found["spans"], lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the spans."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def base_spans(found: Column) -> Column:
    return F.filter(found["spans"], lambda s: s["kind"].isin(*BASE_KINDS))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one mark.

    Null and empty texts stay as they are, and so do all other columns, whatever their names.
    """
    out = fresh("secrets", docs.columns)
    found = find_secrets(docs, text, out)
    spans = F.col(out)["spans"]
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("end"))
    body = F.col(f"`{text}`")

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(body, s["end"] + 1, F.greatest(F.lit(0), x["start"] - s["end"]))
        fresh = (x["start"] >= s["end"]) | (s["end"] == 0)
        return F.struct(
            F.when(fresh, F.concat(s["t"], gap, F.lit(mark))).otherwise(s["t"]).alias("t"),
            F.greatest(s["end"], x["end"]).alias("end"),
        )

    done = F.aggregate(spans, start, step)
    new = F.concat(done["t"], F.substring(body, done["end"] + 1, F.length(body)))
    return found.withColumn(text, F.when(F.size(spans) > 0, new).otherwise(body)).drop(out)
