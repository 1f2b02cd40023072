"""Chromosome names of two tables brought to one style."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwise.functions.coords import chromosome_key
from strandwise.session import stage

SENT_NAMES = 100_000  # aliases (two short texts each) that are sent to every task


def chromosome_aliases(names: DataFrame, to: DataFrame, column: str = "chr") -> DataFrame:
    """``column, alias``: for each distinct name the one that ``to`` uses for the same chromosome.

    The name itself where ``to`` has it, else the first by name among those with the same key; names that ``to`` does
    not know are left out. Both sides are reduced to their distinct names before they meet.
    """
    own, wanted = (t.select(F.col(f"`{column}`").alias("name")).where("name IS NOT NULL").distinct().withColumn("key", chromosome_key(F.col("name"))) for t in (names, to))
    met = own.join(wanted.withColumnRenamed("name", "alias"), "key")
    best = F.min(F.struct((F.col("name") != F.col("alias")).alias("other"), "alias"))
    return met.groupBy("name").agg(best.alias("best")).select(F.col("name").alias(column), F.col("best.alias").alias("alias"))


def harmonise(rows: DataFrame, to: DataFrame, column: str = "chr") -> DataFrame:
    """``rows`` with ``column`` in the names that ``to`` uses; names it does not know stay.

    The dictionary holds a row per distinct name and is counted before it is sent to the rows, which do not move.
    """
    aliases = chromosome_aliases(rows, to, column).where(F.col(column) != F.col("alias"))
    aliases = stage(aliases.select(F.col(column).alias("_name"), F.col("alias").alias("_alias")), "chromosome-aliases")
    small = aliases.count() <= SENT_NAMES
    joined = rows.join(F.broadcast(aliases) if small else aliases, F.col(column) == F.col("_name"), "left")
    return joined.withColumn(column, F.coalesce("_alias", column)).select(*rows.columns)
