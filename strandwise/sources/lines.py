"""Text files with row numbers, and the 'belongs to the latest marker row' rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandwise.operators.intervals import interval_join
from strandwise.operators.ordering import running
from strandwise.session import stage


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as (file, row_no, value), row numbers counted from 0 in each file.

    Rows of one input split are contiguous, so a row's number is its split's offset plus its distance
    to the split's first row. Only one small row per split is grouped; the lines are not shuffled.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = stage(
        lines.groupBy("file", "_block")
        .agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n"),
        "splits",
    )
    return lines.join(splits, ["file", "_block"]).select(
        "file", (F.col("_offset") + F.col("_seq") - F.col("_first")).alias("row_no"), "value"
    )


MARKERS = 1_000_000  # marker rows up to which lines stay where they are


def fill_from_marker(rows: DataFrame, marker: Column, name: str, most: int = MARKERS) -> DataFrame:
    """Give each row of (file, row_no, ...) the value of ``marker`` in the latest row that has one.

    Markers are written and counted. Few are turned into ranges of row numbers, which a range join sends to the lines where
    their size allows; lines move only when there are more than ``most`` markers.
    """
    marked = rows.withColumn("_mark", marker)
    marks = stage(marked.where(F.col("_mark").isNotNull()).select("file", "row_no", "_mark"), "markers")
    if marks.count() > most:
        return running(marked, ["file"], "row_no", "_mark", name, how="last", inclusive=True).drop("_mark")
    ends = rows.groupBy("file").agg(F.min("row_no").alias("_low"), F.max("row_no").alias("_end"))
    # rows before the first marker have a range of their own, without a value
    heads = ends.select("file", F.col("_low").alias("row_no"), F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark"), F.lit(0).alias("_own"))
    placed = heads.unionByName(marks.withColumn("_own", F.lit(1))).join(ends.drop("_low"), "file")
    later = Window.partitionBy("file").orderBy("row_no", "_own")  # markers only
    upto = F.coalesce(F.lead("row_no").over(later) - 1, F.col("_end"))
    ranges = placed.select("file", F.col("row_no").alias("_first"), upto.alias("_last"), F.col("_mark").alias(name)).where(F.col("_first") <= F.col("_last"))
    spans = rows.withColumn("_at", F.col("row_no"))
    met = interval_join(spans, stage(ranges, "marker-ranges"), ("row_no", "_at"), ("_first", "_last"), on=["file"], width=4096, spread=["row_no"])
    return met.select(*rows.columns, name)
