"""Row filters, projections and region selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwise.functions.naming import matches_any
from strandwise.operators.ordering import rank_globally

TRAINING_COLUMNS = ("dna_seq", "methyl_seq", "ctype", "dmr_label")


def clean_reads(reads: DataFrame, required: tuple[str, ...] = TRAINING_COLUMNS) -> DataFrame:
    """Drop rows with a blank required field, a label that is no integer or no usable methylation."""
    filled = [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in required if c in reads.columns]
    keep = F.col("methyl_seq").rlike("[012]")
    for test in filled:
        keep = keep & test
    rows = reads.where(keep)
    if "dmr_label" in reads.columns:
        label = F.col("dmr_label").try_cast("int")
        rows = rows.where(label.isNotNull()).withColumn("dmr_label", label)
    return rows


def filter_regions(regions: DataFrame, types: list[str], match: str = "exact") -> DataFrame:
    """Regions of the given types, by equal name or by canonical part of the name."""
    if match == "exact":
        return regions.where(F.col("cell_type").isin(types))
    if match == "canonical":
        return regions.where(matches_any(F.col("cell_type"), types))
    raise ValueError(f"match must be 'exact' or 'canonical', got {match!r}")


def filter_length(reads: DataFrame, shortest: int = 25) -> DataFrame:
    """Drop reads whose methylation string is too short; applied before long reads are halved."""
    return reads.where(F.length("methyl_seq") >= shortest)


def drop_uninformative(reads: DataFrame) -> DataFrame:
    """Drop reads without any called CpG."""
    return reads.where(F.col("methyl_seq").rlike("[01]"))


def project_training(reads: DataFrame, keep_extra: bool = False) -> DataFrame:
    """The four training columns under their canonical names; optionally read count and region type."""
    names = {c.lower(): c for c in reads.columns}
    wanted = list(TRAINING_COLUMNS)
    if keep_extra:
        wanted += [c for c in ("read_count", "dmr_ctype") if c in names]
    return reads.select(*[F.col(f"`{names[c]}`").alias(c) for c in wanted])


def clamp_label(label: Column, n: int) -> Column:
    """Labels beyond the last known one become the last one."""
    return F.least(label, F.lit(n - 1))


def top_regions(regions: DataFrame, n: int, by: str | None, tie: str = "dmr_label") -> DataFrame:
    """First ``n`` regions per cell type by the absolute statistic, else by ``tie``.

    Spark keeps the best n per task before the shuffle, so a large type does not meet in one task.
    """
    order = [F.abs(F.col(by)).desc()] if by else []
    rank = Window.partitionBy("ctype").orderBy(*order, tie)
    return regions.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= n).drop("_rank")


def assign_region_ids(regions: DataFrame, by: str | None, tie: str) -> DataFrame:
    """Number regions from 0 by falling absolute statistic, unless they already carry ``dmr_id``."""
    if "dmr_id" in regions.columns:
        return regions
    order = [F.abs(F.col(by)).desc()] if by else []
    return rank_globally(regions, *order, tie, rank="dmr_id").withColumn("dmr_id", F.col("dmr_id") - 1)


def pick_regions(regions: DataFrame, per_type: int = 0) -> DataFrame:
    """Regions with a statistic, numbered from 0 in ``dmr_id``; with ``per_type`` the best of every type only.

    Falling ``statistic``, rows without one last, then the order of the file. The best of several types are numbered
    type by type, in the order in which the types first come. Regions that carry ``dmr_id`` keep it.
    """
    falling = [F.desc_nulls_last("statistic"), F.col("row_no")]
    place = Window.partitionBy("ctype").orderBy(*falling)
    kept = regions
    if per_type > 0:
        kept = regions.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= per_type).drop("_place")
    if "dmr_id" in regions.columns:
        return kept
    if per_type <= 0:
        return rank_globally(kept, *falling, rank="dmr_id").withColumn("dmr_id", F.col("dmr_id") - 1)
    # one row per type: its best region says where the type comes
    top = kept.groupBy(F.col("ctype").alias("_type")).agg(F.min(F.struct(F.coalesce(-F.col("statistic"), F.lit(float("inf"))).alias("s"), "row_no")).alias("_top"))
    placed = kept.join(top, F.col("ctype").eqNullSafe(F.col("_type"))).drop("_type")
    ranked = rank_globally(placed, "_top", "ctype", *falling, rank="dmr_id")
    return ranked.withColumn("dmr_id", F.col("dmr_id") - 1).drop("_top")


def first_rows(rows: DataFrame, n: int, key: str) -> DataFrame:
    """The first ``n`` rows by ``key`` (a top-n, not a full sort)."""
    return rows.orderBy(key).limit(n)
