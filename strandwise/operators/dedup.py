"""Collapsing and de-duplicating reads. Keys are aggregated on the map side, so a key that holds a
large share of all rows reaches the shuffle as one row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwise.functions.keys import SEQUENCE, content_digest
from strandwise.functions.reads import read_weight
from strandwise.operators.firsts import NUMBER, lead_numbers, numbered, order_number, order_numbers, rows_at, tied_keys, untied
from strandwise.operators.joins import skew_join
from strandwise.session import stage

COLLAPSE_KEY = ("dna_seq", "methyl_seq", "dmr_label", "ctype", "dmr_ctype")


def collapse_reads(reads: DataFrame, keys: Sequence[str] = COLLAPSE_KEY) -> DataFrame:
    """One row per distinct read with the summed count."""
    return reads.groupBy(*keys).agg(F.sum("read_count").alias("read_count"))


def drop_duplicate_rows(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact duplicates over the given columns (all by default) removed."""
    return rows.select(*(columns or rows.columns)).dropDuplicates()


def duplicate_report(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct rows, removed rows and removed percent; one row, one shuffle."""
    distinct = rows.groupBy(*(columns or rows.columns)).agg(F.count("*").alias("_n"))
    total, kept = F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")
    return distinct.agg(
        total.alias("n_rows"), kept.alias("n_unique"), (total - kept).alias("n_removed"),
        F.round(F.coalesce(100.0 * (total - kept) / F.nullif(total, F.lit(0)), F.lit(0.0)), 4).alias("pct_removed"),
    )


def keep_first(
    reads: DataFrame, keys: Sequence[str] = SEQUENCE, order: str = "row_id", per_sample: bool = False
) -> DataFrame:
    """First row per key by ``order``; an integer read count above 1 becomes 1."""
    groups = (["sample_id"] if per_sample else []) + list(keys)
    keyed = reads.withColumn("_key", content_digest(*groups))
    numbers = order_numbers(keyed, ["_key"], order)
    lead = stage(lead_numbers(numbers, ["_key"]), "first-numbers")
    first = rows_at(keyed, numbers, lead, ["_key"], order).select(*reads.columns)
    if "read_count" not in reads.columns:
        return first
    kind = reads.schema["read_count"].dataType.simpleString()
    above_one = F.col("read_count").try_cast("int") > 1
    return first.withColumn(
        "read_count", F.when(above_one, F.lit(1).cast(kind)).otherwise(F.col("read_count"))
    )


def _with_twin_key(reads: DataFrame) -> DataFrame:
    """Digest of sequence, region, region type and count; a missing count is the text '1' in it."""
    count = F.coalesce(F.col("read_count").cast("string"), F.lit("1"))
    return reads.withColumn("_key", content_digest("dna_seq", "methyl_seq", "dmr_label", "dmr_ctype", count))


def _type_range() -> list[Column]:
    """Smallest and largest 64-bit hash of a key's cell types: equal when the key has one type.

    Numbers, so that the aggregation stays one of fixed width; cell types are a catalogue of names, among which
    two of one hash are not to be expected.
    """
    return [F.min("_type").alias("_lo"), F.max("_type").alias("_hi")]


def _type_number() -> Column:
    return F.when(F.col("ctype").isNotNull(), F.xxhash64("ctype")).alias("_type")


def dedup_cross_sample(reads: DataFrame, order: str = "row_id") -> DataFrame:
    """Keep the first row of every key that has a single cell type, drop keys with several.

    The key leaves the cell type out. Repeats inside one sample count like repeats across samples.
    """
    keyed = _with_twin_key(reads)
    numbers = order_numbers(keyed, ["_key"], order, _type_number())
    lead = lead_numbers(numbers, ["_key"], *_type_range()).where(F.col("_lo") == F.col("_hi"))
    return rows_at(keyed, numbers, stage(lead.drop("_lo", "_hi"), "first-numbers"), ["_key"], order).select(*reads.columns)


def dedup_shared_by_all(
    reads: DataFrame, sample: str = "sample_id", order: str = "row_id", within: Sequence[str] = (), **how
) -> DataFrame:
    """As ``dedup_cross_sample``, but only for keys found in every sample; other keys keep all rows.

    ``within`` names columns that separate independent inputs held in one table. Reads are looked up in the table of
    shared keys, which is sent to them where its size allows; then no read moves.
    """
    within = list(within)
    keyed = _with_twin_key(reads)
    key = [*within, "_key"]
    numbers = numbered(keyed, key, order, _type_number(), sample)
    shared = stage(shared_keys(numbers, key, within, sample), "shared-keys")
    single = F.col("_lo") == F.col("_hi")
    tied = stage(tied_keys(numbers, shared.where(single), key), "tied-keys")
    flagged = shared.withColumn("_at", F.when(single, F.col(NUMBER))).select(*key, "_at", "n")
    if not tied.isEmpty():  # their rows come from the rest of the order
        flagged = flagged.join(tied.select(*key, F.lit(True).alias("_tied")), key, "left")
        flagged = flagged.select(*key, F.when(F.col("_tied").isNull(), F.col("_at")).alias("_at"), "n")
    found = skew_join(
        keyed.withColumn(NUMBER, order_number(keyed, order)), flagged.select(*key, "_at", F.lit(True).alias("_shared")),
        key, "left", spread=[order], counts=flagged.select(*key, "n"), **how,
    )
    kept = found.where(F.col("_shared").isNull() | (F.col("_at") == F.col(NUMBER))).select(*reads.columns)
    if tied.isEmpty():
        return kept
    placed = keyed.withColumn(NUMBER, order_number(keyed, order))
    among = stage(placed.join(tied, [*key, NUMBER], "left_semi").select(*keyed.columns), "tied-rows")
    return kept.unionByName(untied(among, key, order).select(*reads.columns))


def shared_keys(numbers: DataFrame, key: Sequence[str], within: Sequence[str], sample: str) -> DataFrame:
    """Keys found in every sample: their rows, range of types and smallest order number."""
    # (key, sample) first: a hot key shrinks to one row per sample before it meets in one task
    per_sample = lead_numbers(numbers, [*key, sample], F.count("*").alias("_n"), *_type_range())
    per_key = per_sample.groupBy(*key).agg(
        F.sum("_n").alias("n"), F.count("*").alias("_samples"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min(NUMBER).alias(NUMBER),
    )
    if within:
        totals = numbers.select(*within, sample).distinct().groupBy(*within).agg(F.count("*").alias("_all"))
        judged = per_key.join(totals, list(within))
    else:
        judged = per_key.withColumn("_all", F.lit(numbers.select(sample).distinct().count()))
    return judged.where(F.col("_samples") == F.col("_all")).drop("_samples", "_all")


def dedup_report(reads: DataFrame) -> DataFrame:
    """Rows removed by ``dedup_cross_sample`` per cell type and reason."""
    per_type = _with_twin_key(reads).groupBy("_key", "ctype").agg(F.count("*").alias("_n"))
    types = F.count("*").over(Window.partitionBy("_key"))  # as many rows as cell types
    judged = per_type.withColumn("_types", types)
    reason = F.when(F.col("_types") > 1, F.lit("conflict")).otherwise(F.lit("same_label"))
    removed = F.when(F.col("_types") > 1, F.col("_n")).otherwise(F.col("_n") - 1)
    return (
        judged.select("ctype", reason.alias("reason"), removed.alias("_removed"))
        .where(F.col("_removed") > 0)
        .groupBy("ctype", "reason")
        .agg(F.sum("_removed").alias("n_removed"))
    )


def sequence_weights(reads: DataFrame, keys: Sequence[str] = SEQUENCE) -> DataFrame:
    """Summed read count per sequence key; an unusable count weighs 1."""
    weight = read_weight(F.col("read_count")) if "read_count" in reads.columns else F.lit(1)
    return reads.groupBy(*keys).agg(F.sum(weight).alias("weight"), F.count("*").alias("n_rows"))


def expand_counts(reads: DataFrame) -> DataFrame:
    """Each row repeated by its read count; counts below 1 or unusable give one row."""
    times = F.greatest(read_weight(F.col("read_count")), F.lit(1))
    return (
        reads.withColumn("_i", F.explode(F.sequence(F.lit(1), times)))
        .withColumn("read_count", F.lit(1))
        .drop("_i")
    )
