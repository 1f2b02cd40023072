"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Everything here is DataFrame operations. A source may hold any share of the rows: its rows are dealt
by their hash into 65,536 ranges (a range sort by the leading digits), sizes are summed per range on
the map side, and the prefix sum over the range sums finds the one range in which the budget ends.
Rows of earlier ranges are taken, rows of later ones are not, and only the rows of that one range
are sorted and summed one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwise.llm.columns import fresh
from strandwise.session import stage

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 4  # leading hex digits of the hash that name a range
WEIGHTS = (3, 1, 2)
SHARE, EPOCHS = 1.5, 2


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _key(doc_id: str) -> Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def _range(doc_id: str) -> Column:
    return F.conv(F.substring(_key(doc_id), 1, DIGITS), 16, 10).cast("int")


def source_targets(
    docs: DataFrame, size: Column, source: str = "source", weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, epochs: float = EPOCHS,
) -> DataFrame:
    """``source, source_size, target`` (one row per source, null is a source of its own).

    Sources in code point order, null last, get the ``weights`` in turn. Together they share ``share``
    times all sizes; a target stops at ``epochs`` times its source's size and what it gives up is
    shared again by weight until no target is above. One row per source: sources are a catalogue of a
    few thousand names, not keys of documents.
    """
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = stage(sums.withColumn("weight", weight), "mix-sources")
    top = F.col("source_size") * F.lit(float(epochs))
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, closed = 0.0, -1
    while True:
        # sources at their limit give up the rest of their share; the level of the others rises
        at_top = F.col("weight") * F.lit(level) > top
        n, taken, rest = table.agg(
            F.count_if(at_top), F.sum(F.when(at_top, top)), F.sum(F.when(~at_top, F.col("weight")))
        ).first()
        if n == closed or not rest:
            break
        closed, level = n, (total - (taken or 0.0)) / rest
    target = F.when(F.col("weight") * F.lit(level) > top, top).otherwise(F.col("weight") * F.lit(level))
    return table.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source", out: str = "mix",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS,
) -> DataFrame:
    """``docs`` with the struct column ``out``: ``size, source_size, target, taken``.

    ``taken`` counts the size units that the mix takes of the row, repeated epochs included: whole
    epochs take every row, the rest of the budget takes rows in hash order of ``doc_id`` and ends
    inside one row, so a source's sum is its target rounded to a unit. The order depends on the ids
    alone, so reruns agree.

    Null ids share one place in the order, null sources are one source, null or empty texts have size 0
    and take 0. Equal ids follow each other; rows alike in every column are interchangeable. An empty
    table gives an empty table. A column already called ``out`` is replaced; other extra columns stay.
    """
    docs = docs.drop(out)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.cast("long").alias("size"),
        F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{source}`").alias("from"),
    )
    rows = rows.withColumn("range", _range("id"))
    ranges = stage(rows.groupBy("from", "range").agg(F.sum("size").alias("n")), "mix-ranges")
    targets = source_targets(ranges, F.col("n"), "from", weights, share, epochs)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", budget - F.col("whole") * F.col("source_size"))
    upto = F.sum("n").over(Window.partitionBy("from").orderBy("range"))
    summed = ranges.withColumn("upto", upto)
    end = (
        summed.join(plan, summed["from"].eqNullSafe(plan["source"]))
        .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        .groupBy("from").agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
    )
    plan = stage(
        plan.join(end, plan["source"].eqNullSafe(end["from"]), "left").select(
            "source", "source_size", "target", "whole", "rest",
            F.coalesce("end.range", F.lit(-1)).alias("end"), F.coalesce("end.before", F.lit(0)).alias("before"),
        ),
        "mix-plan",
    )
    placed = rows.join(plan, rows["from"].eqNullSafe(plan["source"]), "left")
    sure = placed.where(F.col("range") != F.col("end")).withColumn(
        "taken", (F.col("whole") + (F.col("range") < F.col("end")).cast("long")) * F.col("size")
    )
    order = Window.partitionBy("from", "range").orderBy(_key("id"), "id", "size", F.xxhash64("row"))
    ahead = F.col("before") + F.coalesce(
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    cut = placed.where(F.col("range") == F.col("end")).withColumn("ahead", ahead).withColumn(
        "taken",
        F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead"))),
    ).drop("ahead")
    return sure.unionByName(cut).select(
        "row.*", F.struct("size", "source_size", "target", F.col("taken").cast("long").alias("taken")).alias(out)
    )


def apply_mix(mixed: DataFrame, text: str = "text", out: str = "mix") -> DataFrame:
    """The rows the mix takes: one per whole epoch of a row, and its first words where the budget ends.

    A row cut by the budget keeps the first words of its text joined by one space. Rows of size 0, null texts among
    them, are not taken. Columns other than ``out`` stay, whatever their names.
    """
    part = fresh("cut", mixed.columns)
    size, taken = F.col(f"{out}.size"), F.col(f"{out}.taken")
    copies = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    rest = (taken - copies * size).cast("int")
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), rest), " ")
    parts = F.concat(
        F.array_repeat(F.lit(False), copies),
        F.when(rest > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
    )
    rows = mixed.select(*[f"`{c}`" for c in mixed.columns], F.explode(parts).alias(part))
    return rows.withColumn(text, F.when(F.col(part), cut).otherwise(F.col(text))).drop(part, out)
