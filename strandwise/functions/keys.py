"""Content keys and reproducible orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SEQUENCE = ("dna_seq", "methyl_seq")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_key(*cols: Column | str) -> Column:
    """128-bit hex key of the given columns. Different values, null and empty text among them, give different keys.

    The parts are joined by a bar; bars and backslashes inside them are escaped.
    """

    def part(c: Column | str) -> Column:
        text = as_col(c).cast("string")
        plain = F.when(text.rlike(r"[|\\]"), F.regexp_replace(text, r"([|\\])", r"\\$1")).otherwise(text)
        return F.coalesce(plain, F.lit("\\0"))

    return F.md5(F.concat_ws("|", *[part(c) for c in cols]))


def content_digest(*cols: Column | str) -> Column:
    """``content_key`` as 16 bytes: half the width in a shuffle."""
    return key_digest(content_key(*cols))


def key_digest(key: Column) -> Column:
    """The 16 bytes of a hex key. Never null, so that a join on it needs no test for null, which would compute the key twice."""
    return F.coalesce(F.unhex(key), F.lit(b""))


def shuffle_key(*cols: Column | str, seed: int = 42) -> Column:
    """Hex text whose sort order is a seeded shuffle of the given columns, the same in every engine."""
    return F.md5(F.concat_ws("|", *[as_col(c).cast("string") for c in cols], F.lit(str(seed))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is evaluated again for every element; bound as the single
    element of an array it becomes a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
