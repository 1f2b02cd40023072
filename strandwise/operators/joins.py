"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strandwise.session import stage

HOT_ROWS = 2_000_000


def dealt(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``rows`` over all shuffle partitions (or ``parts``) by a hash of their place, whatever the number of input splits.

    Files that cannot be split give one task each; what comes after this runs on all of them. The number of
    partitions is fixed, so small ones are not merged back.
    """
    place, spot = "_deal_place", "_deal_spot"
    numbered = rows.withColumn(place, F.monotonically_increasing_id())
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered.withColumn(spot, F.xxhash64(place)).repartition(parts, spot).drop(place, spot)


def skew_join(
    big: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``big`` to ``other`` on ``keys``, splitting the hot keys of ``big`` over several tasks.

    A key with more than ``hot_rows`` rows is cut into parts of that size by a hash of the ``spread``
    columns (all columns of ``big`` by default; they should tell its rows apart), and the few rows
    of ``other`` with that key are repeated once per part. There are at most rows / hot_rows such
    keys. ``counts`` (``keys + n``) saves the counting pass when the caller already has it. Works for
    inner, left, left semi and left anti joins.
    """
    keys = list(keys)
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count("*").alias("n"))
    hot = stage(
        counts.where(F.col("n") > hot_rows).select(
            *keys, F.ceil(F.col("n") / hot_rows).cast("int").alias("_parts")
        ),
        "hot-keys",
    )
    if hot.isEmpty():
        return big.join(other, keys, how)
    spread = list(spread) or big.columns
    salted = big.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_parts").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts").cast("long")).cast("int")),
    )
    repeated = (
        other.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_parts")
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt", "_parts")
