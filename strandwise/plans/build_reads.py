"""From fragments and marker regions to labelled reads, all samples in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from strandwise.functions.keys import let
from strandwise.functions.reads import clean_bases, context_span, impute_missing, kmers, methyl_string
from strandwise.operators.genome import slice_reference
from strandwise.operators.intervals import interval_join, overlap_fragments
from strandwise.session import stage


def prepare_regions(regions: DataFrame, cpg: DataFrame, genome: DataFrame, chunk: int) -> DataFrame:
    """Regions with CpG range, bases and the CpGs that a 3-mer can show, as a written table.

    A CpG is showable when a base precedes its C and its G lies inside the region. One range join
    gives the index range and the list.
    """
    spans = regions.select("dmr_label", "chr", F.col("start").alias("_start"), F.col("end").alias("_end"))
    points = cpg.select("chr", "pos", F.col("pos").alias("_pos_end"), "cpg_idx")
    inside = interval_join(points, spans, ("pos", "_pos_end"), ("_start", "_end"), width=4096)
    shown = (F.col("pos") > F.col("_start")) & (F.col("pos") < F.col("_end"))
    ranged = inside.groupBy("dmr_label").agg(
        F.min("cpg_idx").alias("cpg_start"), F.max("cpg_idx").alias("cpg_end"),
        # distinct positions inside one region, so no longer than the region
        F.array_sort(F.collect_list(F.when(shown, F.struct("pos", "cpg_idx")))).alias("cpgs"),
    )
    marked = slice_reference(regions, genome, chunk).join(ranged.where(F.size("cpgs") > 0), "dmr_label")
    return stage(marked, "marked-regions")


def assemble(pairs: DataFrame) -> DataFrame:
    """Bases and methylation string of every overlapping (fragment, region) pair.

    Each step explodes a list of at most one result: a pair without one disappears, and the optimizer
    cannot move the step's expression into the join condition, where it would be computed twice.
    """
    keep = ["sample_id", "ctype", "dmr_label", "dmr_ctype", "read_count"]
    covered = F.filter(
        "cpgs", lambda c: (c["cpg_idx"] >= F.col("cpg_start")) & (c["cpg_idx"] <= F.col("cpg_end"))
    )
    pairs = pairs.withColumnRenamed("cell_type", "dmr_ctype")
    spans = pairs.select(
        *keep, "cpg_start", "start", "ref_seq", "pattern",
        F.explode(F.filter(F.array(covered), lambda c: F.size(c) > 0)).alias("_covered"),
    )
    first_c = (F.element_at("_covered", 1)["pos"] - F.col("start")).cast("int")
    last_g = (F.element_at("_covered", -1)["pos"] - F.col("start") + 1).cast("int")
    low, high = context_span(F.col("ref_seq"), F.col("_first_c"), F.col("_last_g"))
    placed = (
        spans.withColumns({"_first_c": first_c, "_last_g": last_g})
        .select("*", F.inline(F.array(F.struct(low.alias("_low"), high.alias("_high")))))
        .withColumn("_tokens", F.col("_high") - F.col("_low") - 1)
        .where(F.col("_tokens") > 0)
    )

    def spelled(filled: Column) -> Column:
        state = lambda c: F.translate(
            F.substring(filled, (c["cpg_idx"] - F.col("cpg_start") + 1).cast("int"), F.lit(1)), "CT.", "102"
        )
        states = F.transform("_covered", lambda c: F.struct(c["pos"].alias("pos"), state(c).alias("state")))
        return F.struct(
            clean_bases(F.substring("ref_seq", F.col("_low") + 1, F.col("_tokens") + 2)).alias("bases"),
            methyl_string(states, F.col("start") + F.col("_low"), F.col("_tokens")).alias("methyl_seq"),
        )

    read = let(impute_missing(F.col("pattern")), spelled)
    informative = F.filter(F.array(read), lambda r: r["methyl_seq"].rlike("[01]"))
    return placed.select(*keep, F.inline(informative))


def build_reads(
    fragments: DataFrame,
    regions: DataFrame,
    cpg: DataFrame,
    genome: DataFrame,
    chunk: int,
    collapse: bool = True,
    **how,
) -> DataFrame:
    """Labelled reads of all samples.

    ``fragments`` carry ``sample_id`` and ``ctype``. Region bases are cut once per region and travel
    with it through the interval join. Reads are collapsed on their bases; 3-mers, four times as long,
    are spelled out only afterwards.
    """
    marked = prepare_regions(regions, cpg, genome, chunk)
    reads = assemble(overlap_fragments(fragments, marked, **how))
    if collapse:
        reads = reads.groupBy("sample_id", "bases", "methyl_seq", "dmr_label", "ctype", "dmr_ctype").agg(
            F.sum("read_count").alias("read_count")
        )
    else:
        reads = reads.withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest("read_count", F.lit(1))))).withColumn(
            "read_count", F.lit(1)
        ).drop("_i")
    return reads.select(
        "sample_id", kmers(F.col("bases")).alias("dna_seq"), "methyl_seq", "dmr_label", "ctype", "dmr_ctype", "read_count"
    )


def extract_reads(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """User-supplied extractor in place of the built-in one: an iterator of pandas frames to another."""
    return rows.mapInPandas(fn, schema)


__all__ = ["assemble", "build_reads", "extract_reads", "prepare_regions"]
