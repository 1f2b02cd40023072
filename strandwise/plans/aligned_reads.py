"""From aligned reads and marker regions to training reads, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwise.functions.alignments import decode_bismark, decoded_kmers, query_length, reference_length
from strandwise.operators.genome import slice_reference
from strandwise.operators.intervals import contain_join
from strandwise.operators.naming_styles import harmonise
from strandwise.operators.selection import pick_regions
from strandwise.operators.splitting import split_train_valid_test
from strandwise.session import stage

SPANS = {"query": query_length, "reference": reference_length}


def aligned_reads(alignments: DataFrame, regions: DataFrame, genome: DataFrame, chunk: int, span: str = "query", **how) -> DataFrame:
    """Reads that lie wholly inside a region, as 3-mers and methylation strings; one row per read and region.

    ``alignments`` hold ``qname, flag, chr, pos`` (0-based), ``cigar`` and ``xm``, and may hold ``ctype`` (``NA`` without
    it) and ``filename``. ``regions`` hold ``dmr_id, chr, start, end, ctype`` with a 0-based start and an end beyond the last
    base. A read ends after its aligned bases; with ``span="reference"`` after the reference bases it spans, so that
    deletions and skipped stretches count and insertions do not.

    Names of chromosomes are brought to the genome's style first. Bases are cut once per region, travel with it
    through the range join, and a read takes its part by its offset. Duplicates, reads without a CpG call or without a CpG
    in their part, and reads with a non-CpG call inside a CpG have no row.
    """
    if span not in SPANS:
        raise ValueError(f"span must be one of {sorted(SPANS)}, got {span!r}")
    spots = harmonise(regions, genome).select(
        "dmr_id", "chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("ctype").alias("dmr_ctype"), (F.col("start") + 1).alias("_first")
    )
    marked = stage(slice_reference(spots.where(F.col("end") > F.col("start")), genome, chunk, "_first", "end", "dmr_id").drop("_first"), "marked-regions")
    named = [c for c in ("filename",) if c in alignments.columns]
    ctype = F.coalesce("ctype", F.lit("NA")) if "ctype" in alignments.columns else F.lit("NA")
    placed = harmonise(alignments, genome).select(
        "qname", *named, ctype.alias("ctype"), "flag", "chr", "pos", (F.col("pos") + SPANS[span](F.col("cigar"))).alias("pos_end"), "cigar", "xm"
    )
    met = contain_join(placed.where(F.col("pos_end") > F.col("pos")), marked, spread=["qname", "pos"], **how)
    part = F.substring("ref_seq", (F.col("pos") - F.col("region_start") + 1).cast("int"), (F.col("pos_end") - F.col("pos")).cast("int"))
    decoded = met.withColumn("_ref", part).withColumn("_d", decode_bismark("_ref", "xm", "cigar", "flag"))
    keep = ["qname", *named, "ctype", "chr", "pos", "flag", "dmr_id", "dmr_ctype"]
    # a list of at most one result: a read without one disappears, and the decoding is done once
    read = F.filter(F.array("_d.bases"), lambda b: b.isNotNull() & b.rlike("[zZ]"))
    spelled = decoded.select(*keep, F.explode(read).alias("_bases"))
    dna, methyl = decoded_kmers(F.col("_bases"))
    return spelled.select(
        F.col("qname").alias("name"), *keep[1:-2], dna.alias("dna_seq"), methyl.alias("methyl_seq"), F.col("dmr_id").alias("dmr_label"), "dmr_ctype"
    )


def aligned_training(
    alignments: DataFrame, regions: DataFrame, genome: DataFrame, chunk: int, per_type: int = 0,
    ratios: tuple[float, float, float] = (1.0, 0.0, 0.0), by: str = "name", span: str = "query", seed: int = 42, **how,
) -> DataFrame:
    """``aligned_reads`` against the best ``per_type`` regions of each type (all by default), with ``side``.

    Reads of one name, or one file with ``by="filename"``, stay on one side; names are drawn per cell type.
    """
    picked = stage(pick_regions(regions, per_type), "picked-regions")
    reads = stage(aligned_reads(alignments, picked, genome, chunk, span, **how), "aligned-reads")
    return split_train_valid_test(reads, ratios, by, seed=seed)
