"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwise.functions.reads import kmers
from strandwise.session import stage
from strandwise.sources.readers import READ_COLUMNS

FORMATS = ("parquet", "csv", "tsv")


def write_reads(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "append") -> None:
    """Labelled reads as Parquet, CSV with header, or TSV training text."""
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {FORMATS}, got {fmt!r}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    else:
        writer.csv(path, header=True, sep="\t" if fmt == "tsv" else ",")


def write_split(reads: DataFrame, path: str, side: str = "side", fmt: str = "tsv") -> None:
    """Train and test tables side by side, one folder per side."""
    write_reads(reads, path, fmt, partition_by=[side], mode="overwrite")


def write_bed(df: DataFrame, path: str, header: bool = False) -> list[str]:
    """Tab-separated output without the columns that are null in every row; returns the kept ones."""
    used = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    kept = [c for c in df.columns if used[c] > 0]
    df.select(*[F.col(f"`{c}`") for c in kept]).write.mode("overwrite").csv(path, sep="\t", header=header)
    return kept


SECTION_ROWS = 1_000_000


def write_sectioned(reads: DataFrame, path: str, section_rows: int = SECTION_ROWS, bases: bool = False) -> None:
    """Reads as CSV text where a ``*.pat.gz`` row opens each section.

    With ``bases`` the reads hold bases in ``dna_seq``, and their 3-mers, four times as long, are spelled where they are written.

    A sample is spread over as many sections as its number of rows asks for, each opened by its own marker
    row, so that the work per task stays the same however large a sample is.
    """
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in READ_COLUMNS}
    if bases:
        cells["dna_seq"] = F.col("dna_seq")
    parts = stage(reads.groupBy("sample_id").agg(F.ceil(F.count("*") / section_rows).alias("_parts")), "section-parts")
    part = F.pmod(F.xxhash64(*cells.values()), F.col("_parts"))
    data = reads.join(parts, "sample_id").select("sample_id", part.alias("_part"), F.lit(1).alias("_kind"), *[v.alias(c) for c, v in cells.items()])
    marks = data.select("sample_id", "_part").distinct().withColumn("_kind", F.lit(0))
    sections = marks.unionByName(data, allowMissingColumns=True).repartition("sample_id", "_part").sortWithinPartitions("sample_id", "_part", "_kind")
    line = F.concat_ws(",", *[kmers(F.col(c)) if bases and c == "dna_seq" else F.col(c) for c in READ_COLUMNS])
    value = F.when(F.col("_kind") == 0, F.concat("sample_id", F.lit(".pat.gz"))).otherwise(line)
    sections.select(value.alias("value")).write.mode("overwrite").text(path)


def write_composition(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Composition report per sample and region type as JSON lines or tab-separated text."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "tsv":
        df.write.mode("overwrite").csv(path, sep="\t", header=True)
    else:
        raise ValueError(f"fmt must be 'json' or 'tsv', got {fmt!r}")
