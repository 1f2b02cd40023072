"""Interval joins on closed ranges, as equi-joins on fixed-width bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandwise.operators.joins import skew_join
from strandwise.session import stage

# A side is broadcast only when it is counted to stay within both limits.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 << 20


def _bin(position: Column, width: int) -> Column:
    return F.call_function("div", position, F.lit(width))


def _bins(start: Column, end: Column, width: int) -> Column:
    first = _bin(start, width)
    return F.sequence(first, F.greatest(first, _bin(end, width)))


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row, from the lengths of its texts and arrays; nothing is written out to tell."""

    def size(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) + 8
        if isinstance(kind, (T.ArrayType, T.MapType)):
            inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
            return F.greatest(F.size(F.col(f"`{name}`")), F.lit(0)) * (16 * len(inner.fields) if isinstance(inner, T.StructType) else 16)
        return F.lit(16 * len(kind.fields) if isinstance(kind, T.StructType) else 8)

    total = F.lit(0)
    for field in df.schema:
        total = total + size(field.name, field.dataType)
    return total.cast("long")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    on: Sequence[str] = ("chr",),
    width: int = 1024,
    contained: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    spread: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """All (left, right) pairs equal in ``on`` whose closed ranges overlap.

    Both sides are listed under every bin they touch and joined on the bin; a pair sharing several
    bins is kept only in the bin where the later of the two starts lies. With ``contained`` the left
    range must lie inside the right one. ``right`` is the smaller side and is read twice: it is broadcast when its
    counted bin rows and the size of their columns are within ``broadcast_rows`` and ``broadcast_bytes``;
    beyond that both sides are shuffled on (``on``, bin) and bins holding very many left rows are split.
    Columns other than ``on`` must differ between the sides.
    """
    on = list(on)
    ls, le = (F.col(c) for c in left_span)
    rs, re = (F.col(c) for c in right_span)
    bins = F.size(_bins(rs, re, width))
    size = right.agg(F.sum(bins), F.sum(bins * row_bytes(right))).first()
    small = (size[0] or 0) <= broadcast_rows and (size[1] or 0) <= broadcast_bytes
    # One comparison over both sides also rules out empty ranges. As it cannot be split into one-sided
    # filters, the span expressions of the big side are not evaluated again below the join.
    meet = F.greatest(ls, rs) <= F.least(le, re)
    if contained:
        # the bin of the left start always belongs to a range that contains the left range
        binned = left.withColumn("_bin", _bin(ls, width))
        keep = meet & (rs <= ls) & (le <= re)
    else:
        binned = left.withColumn("_bin", F.explode(_bins(ls, le, width)))
        keep = meet & (F.col("_bin") == _bin(F.greatest(ls, rs), width))
    targets = right.withColumn("_bin", F.explode(_bins(rs, re, width)))
    keys = [*on, "_bin"]
    if small:
        joined = binned.join(F.broadcast(targets), keys)
    else:
        extra = {} if hot_rows is None else {"hot_rows": hot_rows}
        joined = skew_join(binned, targets, keys, spread=spread or left.columns, **extra)
    return joined.where(keep).drop("_bin")


def attach_cpg_range(regions: DataFrame, cpg: DataFrame, width: int = 4096) -> DataFrame:
    """Add first and last CpG index of the positions inside each region; null where there is none.

    The index points are the big side; per region only a minimum and a maximum travel.
    """
    found = (
        interval_join(
            cpg.select("chr", F.col("pos").alias("_pos"), F.col("pos").alias("_pos_end"), "cpg_idx"),
            regions.select("dmr_label", "chr", F.col("start").alias("_start"), F.col("end").alias("_end")),
            ("_pos", "_pos_end"), ("_start", "_end"), width=width,
        )
        .groupBy("dmr_label")
        .agg(F.min("cpg_idx").alias("cpg_start"), F.max("cpg_idx").alias("cpg_end"))
    )
    return regions.drop("cpg_start", "cpg_end").join(found, "dmr_label", "left")


def require_cpgs(regions: DataFrame) -> DataFrame:
    """Drop regions without a CpG range."""
    return regions.where(F.col("cpg_start").isNotNull() & F.col("cpg_end").isNotNull())


def cpg_count(start: Column, end: Column) -> Column:
    """Number of CpGs in a closed index range, 0 when there is none."""
    return F.coalesce(end - start + 1, F.lit(0))


def overlap_fragments(fragments: DataFrame, regions: DataFrame, width: int = 1024, **how) -> DataFrame:
    """Fragments meeting regions in CpG space; the region's own columns are prefixed ``region_``."""
    spans = regions.withColumnsRenamed({"cpg_start": "region_cpg_start", "cpg_end": "region_cpg_end"})
    return interval_join(
        fragments, spans, ("cpg_start", "cpg_end"), ("region_cpg_start", "region_cpg_end"), width=width, **how
    )


def overlap_regions(regions: DataFrame, target: Column, width: int = 65536, **how) -> DataFrame:
    """Regions of any type meeting, in bases, a region that fulfils ``target``; lists the target types."""
    wanted = regions.where(target).select(
        "chr", F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("cell_type").alias("_type")
    )
    hits = (
        interval_join(regions, wanted, ("start", "end"), ("_start", "_end"), width=width, **how)
        .groupBy("dmr_label")
        .agg(F.array_sort(F.collect_set("_type")).alias("target_types"))
    )
    return regions.join(hits, "dmr_label")


def contain_join(reads: DataFrame, regions: DataFrame, width: int = 65536, **how) -> DataFrame:
    """Aligned reads lying wholly inside a region: ``pos >= start`` and ``pos + length <= end``."""
    spans = regions.withColumnsRenamed({"start": "region_start", "end": "region_end"})
    return interval_join(
        reads, spans, ("pos", "pos_end"), ("region_start", "region_end"), width=width, contained=True, **how
    )


def region_cpgs(regions: DataFrame, cpg: DataFrame, width: int = 4096) -> DataFrame:
    """One row per CpG inside a region with its 0-based ordinal.

    Index ids are consecutive along a chromosome, so the ordinal is the distance to the region's
    first id and needs no sort.
    """
    spans = regions.select(
        "dmr_label", "chr", F.col("start").alias("_start"), F.col("end").alias("_end"), "cpg_start"
    )
    spans = stage(spans, "region-spans")  # a range join of its own as a rule, and read twice here
    points = cpg.select("chr", "pos", F.col("pos").alias("_pos_end"), "cpg_idx")
    hits = interval_join(points, spans, ("pos", "_pos_end"), ("_start", "_end"), width=width)
    return hits.select("dmr_label", "chr", "pos", "cpg_idx", (F.col("cpg_idx") - F.col("cpg_start")).alias("ordinal"))


def select_regions(regions: DataFrame, samples: DataFrame, mode: str = "all") -> DataFrame:
    """Regions each sample is read against: every region, or only those of the sample's own type.

    For ``all`` nothing depends on the sample, so the regions come back once and unpaired.
    """
    if mode == "all":
        return regions
    if mode != "target":
        raise ValueError(f"mode must be 'all' or 'target', got {mode!r}")
    return regions.join(
        samples.select("sample_id", F.col("cell_type")), "cell_type"
    )
