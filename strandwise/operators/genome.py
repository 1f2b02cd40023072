"""Reference genome kept as a table of fixed-width chunks (chr, chunk_id, seq).

Positions are 1-based: base ``i`` (0-based) of chunk ``c`` has position ``c * width + i + 1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandwise.functions.reads import kmers
from strandwise.operators.ordering import rank_positions, running
from strandwise.session import stage


def slice_reference(
    spans: DataFrame, genome: DataFrame, chunk: int, start: str = "start", end: str = "end", key: str = "dmr_label", name: str = "ref_seq"
) -> DataFrame:
    """Bases of every closed span [start, end]; what is not stored reads as N, so the length always fits.

    An equi-join on (chr, chunk_id); a span collects only the chunks it covers, so its group is as
    long as the span. Cut once per region, not per read. Spans of which no base is stored are left out.
    """
    first = F.floor((F.col(start) - 1) / chunk)
    last = F.floor((F.col(end) - 1) / chunk)
    wanted = spans.select(key, "chr", start, end).withColumn("chunk_id", F.explode(F.sequence(first, last)))
    cut = (
        wanted.join(genome.select("chr", "chunk_id", "seq"), ["chr", "chunk_id"], "left")
        .groupBy(key)
        .agg(
            F.array_sort(F.collect_list(F.struct("chunk_id", F.rpad(F.coalesce("seq", F.lit("")), chunk, "N").alias("seq")))).alias("_parts"),
            F.min("chunk_id").alias("_low"), F.first(start).alias("_start"), F.first(end).alias("_end"), F.count("seq").alias("_stored"),
        )
        .where("_stored > 0")
        .select(
            key,
            F.upper(
                F.substring(
                    F.array_join(F.col("_parts.seq"), ""),
                    (F.col("_start") - F.col("_low") * chunk).cast("int"),
                    (F.col("_end") - F.col("_start") + 1).cast("int"),
                )
            ).alias(name),
        )
    )
    return spans.join(cut, key)


def index_cpgs(genome: DataFrame, chunk: int) -> DataFrame:
    """CpG index of the genome: (chr, pos of the C, running number over chromosomes and positions).

    A CG on a chunk border is seen by joining each chunk with the first base of the next one.
    """
    heads = genome.select("chr", (F.col("chunk_id") - 1).alias("chunk_id"), F.left("seq", F.lit(1)).alias("_next"))
    joined = genome.join(heads, ["chr", "chunk_id"], "left").select(
        "chr", "chunk_id", F.concat("seq", F.when(F.length("seq") == chunk, F.coalesce("_next", F.lit(""))).otherwise("")).alias("_text")
    )
    size = F.length("_text")
    spots = joined.where(size > 1).withColumn("_at", F.explode(F.sequence(F.lit(1), size - 1)))
    points = spots.where(F.substring(F.col("_text"), F.col("_at"), F.lit(2)) == "CG").select(
        "chr", (F.col("chunk_id") * chunk + F.col("_at")).alias("pos")
    )
    # ranking reads them twice, the genome and its neighbours are met once
    return rank_positions(stage(points, "cpg-points"), "chr", "pos", "cpg_idx")


def genome_windows(genome: DataFrame, chunk: int, length: int = 510, chromosomes: list[str] | None = None) -> DataFrame:
    """Gap-free windows of ``length`` bases per chromosome, starting over after every chunk with an N.

    Chunks play the role of the lines of the source file: one that holds an N, and a missing one, ends
    the current stretch. Returns (chr, start, kmers); the last partial window of a stretch is dropped.
    """
    g = genome if chromosomes is None else genome.where(F.col("chr").isin(chromosomes))
    clean = g.where(~F.contains(F.upper("seq"), F.lit("N")))
    # start of the stretch a chunk belongs to: the latest chunk whose left neighbour is not clean
    left = clean.select("chr", (F.col("chunk_id") + 1).alias("chunk_id"), F.lit(True).alias("_joined"))
    marked = clean.join(left, ["chr", "chunk_id"], "left").withColumn(
        "_head", F.when(F.col("_joined").isNull(), F.col("chunk_id"))
    )
    placed = running(marked, ["chr"], "chunk_id", "_head", "_first", how="last", inclusive=True)
    at = (F.col("chunk_id") - F.col("_first")) * chunk
    size = F.length("seq")
    pieces = placed.select(
        "chr", "_first", at.alias("_at"), "seq",
        F.explode(F.sequence(F.floor(at / length), F.floor((at + size - 1) / length))).alias("_w"),
    )
    low = F.greatest(F.col("_at"), F.col("_w") * length)
    high = F.least(F.col("_at") + F.length("seq"), (F.col("_w") + 1) * length)
    part = F.substring("seq", (low - F.col("_at") + 1).cast("int"), (high - low).cast("int"))
    windows = (
        pieces.select("chr", "_first", "_w", F.struct(low.alias("low"), F.upper(part).alias("text")).alias("p"))
        .groupBy("chr", "_first", "_w")
        .agg(F.array_sort(F.collect_list("p")).alias("_parts"))  # at most `length` pieces
        .select("chr", (F.col("_first") * chunk + F.col("_w") * length + 1).alias("start"), F.array_join(F.col("_parts.text"), "").alias("_seq"))
    )
    return windows.where(F.length("_seq") == length).select("chr", "start", kmers(F.col("_seq"), 3, drop_last=True).alias("kmers"))
