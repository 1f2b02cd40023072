"""The first row of every key, found by numbers alone and fetched afterwards.

Keeping whole rows while keys are aggregated makes every buffer as wide as a row, and Spark then sorts where it could
hash. Here the aggregation sees keys and 64-bit numbers that follow the order, a few dozen bytes per row. Whole rows are read
once more and move once, to a join on (key, number), which spreads the rows of a frequent key over all tasks. Ties show in
the number of rows found; only then they are looked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandwise.session import stage

BYTES = 7  # letters of an order text per number
NUMBER = "_number"
LAST = (1 << 63) - 1  # null orders come last


def order_number(rows: DataFrame, order: str, part: int = 0) -> Column:
    """A 64-bit number that follows the order: whole numbers, dates and times as they are, texts seven bytes at a time."""
    kind, value = rows.schema[order].dataType, F.col(f"`{order}`")
    if isinstance(kind, T.IntegralType):
        number = value.cast("long")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(value).cast("long")
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(value)
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        digits = F.hex(F.substring(value.cast("binary"), part * BYTES + 1, BYTES))
        number = F.conv(F.rpad(digits, 2 * BYTES, "0"), 16, 10).cast("long")
    else:
        raise TypeError(f"{order} has type {kind.simpleString()}: rows are ordered by whole numbers, times or texts")
    return F.coalesce(number, F.lit(LAST))


def order_numbers(rows: DataFrame, key: Sequence[str], order: str, *more: Column | str) -> DataFrame:
    """``key``, the order number of each row and ``more``."""
    return rows.select(*key, order_number(rows, order).alias(NUMBER), *more)


def numbered(rows: DataFrame, key: Sequence[str], order: str, *more: Column | str) -> DataFrame:
    """``order_numbers`` as a written table, for those who read them more than once."""
    return stage(order_numbers(rows, key, order, *more), "order-numbers")


def lead_numbers(numbers: DataFrame, key: Sequence[str], *more: Column) -> DataFrame:
    """``key``, the smallest number of each key, and ``more`` aggregates; numbers keep it a hash aggregation."""
    return numbers.groupBy(*key).agg(F.min(NUMBER).alias(NUMBER), *more)


def tied_keys(numbers: DataFrame, lead: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with several rows at their smallest number; usually none."""
    met = numbers.select(*key, NUMBER).join(lead.select(*key, NUMBER), [*key, NUMBER])
    return met.groupBy(*key, NUMBER).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(*key, NUMBER)


def untied(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key by the rest of the order: its later letters, its length, then a hash of the row.

    Rows alike in every column are one row. Each step keeps the rows at the smallest number, so only rows that still tie
    are looked at again.
    """
    longest = rows.agg(F.max(F.octet_length(F.col(f"`{order}`").cast("string")))).first()[0] or 0
    text = isinstance(rows.schema[order].dataType, (T.StringType, T.BinaryType))
    numbers = [order_number(rows, order, part) for part in range(1, -(-longest // BYTES))] if text else []
    numbers += [F.coalesce(F.octet_length(F.col(f"`{order}`").cast("string")), F.lit(0)).cast("long"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])]
    for number in numbers:
        placed = rows.withColumn(NUMBER, number)
        least = placed.groupBy(*key).agg(F.min(NUMBER).alias(NUMBER))
        rows = stage(placed.join(least, [*key, NUMBER], "left_semi").drop(NUMBER), "tied-rows")
    return rows.dropDuplicates()


def rows_at(
    rows: DataFrame, numbers: DataFrame, lead: DataFrame, key: Sequence[str], order: str, carried: Sequence[str] = ()
) -> DataFrame:
    """The first row by ``order`` of each key in ``lead`` (a written table of ``lead_numbers`` of ``numbers``), as a written table.

    Rows that share the smallest number are told apart by the rest of their order: there are some when more rows than keys
    are found. ``carried`` columns of ``lead`` come with the rows. Null keys have no row.
    """
    names = rows.columns
    placed = rows.withColumn(NUMBER, order_number(rows, order))
    found = stage(placed.join(lead.select(*key, NUMBER, *carried), [*key, NUMBER]).select(*names, *carried), "first-rows")
    whole = lead
    for name in key:
        whole = whole.where(F.col(f"`{name}`").isNotNull())
    if found.count() == whole.count():
        return found
    tied = stage(tied_keys(numbers, lead, key), "tied-keys").select(*key)
    clear = found.join(tied, list(key), "left_anti").select(*found.columns)
    single = untied(stage(found.join(tied, list(key), "left_semi").select(*names), "tied-rows"), key, order)
    if carried:
        single = single.join(lead.select(*key, *carried), list(key)).select(*found.columns)
    return stage(clear.unionByName(single), "first-rows")
