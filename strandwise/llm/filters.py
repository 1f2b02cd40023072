"""A filter of bounded size for keys that are too many to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandwise.llm.columns import fresh
from strandwise.session import stage

WORDS = 1 << 18  # of 64 bits: 4 MB with their numbers


def with_flag(df: DataFrame, key: Column, members: DataFrame, out: str) -> DataFrame:
    """``df`` with the boolean ``out``: false only where the 64-bit hash ``key`` is not in ``members`` (key).

    Each member sets one bit among ``WORDS * 64``. With more members more rows pass that need not; rows
    that pass are to be joined with the members, those that do not need no shuffle. The bits are
    combined in Spark, and at most ``WORDS`` rows of two numbers are broadcast whatever the input. A column called
    ``out`` is replaced; other columns stay, whatever their names.
    """
    number, word, bits = (fresh(n, [*df.columns, out]) for n in ("_key", "_word", "_bits"))
    place = lambda k: F.shiftright(k.bitwiseAND(F.lit(WORDS * 64 - 1)), 6)
    words = members.select("key", place(F.col("key")).alias(word), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("m"))
    words = stage(words.groupBy(word).agg(F.bit_or("m").alias(bits)), "filter-words")
    marked = df.withColumn(number, key).withColumn(word, place(F.col(number))).join(F.broadcast(words), word, "left")
    flag = F.coalesce(F.expr(f"shiftright(`{bits}`, cast(`{number}` & 63 as int)) & 1") == 1, F.lit(False))
    return marked.withColumn(out, flag).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)
