"""Train / test splits.

Every split is a cut in a seeded hash order of a key. The cut is found from counts (see
``operators.ordering``), and each row then decides its side by comparing its own hash with the cut
of its group: rows are neither sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwise.functions.keys import SEQUENCE, shuffle_key
from strandwise.functions.reads import read_weight
from strandwise.operators.dedup import dedup_cross_sample, dedup_shared_by_all, keep_first
from strandwise.operators.joins import skew_join
from strandwise.operators.ordering import flag_prefix, prefix_cuts
from strandwise.session import stage

TRAIN_SHARE = 0.75
SEED = 42


def _portion(ratio: float):
    return lambda total: F.floor(total * F.lit(float(ratio)))


def _sides(flagged: DataFrame) -> DataFrame:
    return flagged.withColumn(
        "side", F.when(F.col("_first"), F.lit("train")).otherwise(F.lit("test"))
    ).drop("_first", "_order")


def split_stratified(
    reads: DataFrame, ratio: float = 0.8, key: Sequence[str] = ("row_id",), by: Sequence[str] = ("ctype",), seed: int = SEED
) -> DataFrame:
    """Per cell type, ``floor(n * ratio)`` rows go to train. ``key`` must tell rows apart."""
    keyed = reads.withColumn("_order", shuffle_key(*key, seed=seed))
    cuts = prefix_cuts(keyed, by, "_order", _portion(ratio))
    return _sides(flag_prefix(keyed, cuts, by, "_order", "_first"))


def split_random(reads: DataFrame, ratio: float = TRAIN_SHARE, key: Sequence[str] = ("row_id",), seed: int = SEED) -> DataFrame:
    """Whole-table shuffle cut at ``floor(n * ratio)``; duplicates are not looked at."""
    return split_stratified(reads, ratio, key, (), seed)


def split_by_sequence(
    reads: DataFrame, ratio: float = TRAIN_SHARE, by: Sequence[str] = ("ctype",), keys: Sequence[str] = SEQUENCE, seed: int = SEED
) -> DataFrame:
    """Rows with the same sequence stay on one side inside their cell type.

    Groups are taken in hash order; the one that crosses the target goes to the nearer side, so the
    row ratio is off by at most half a group.
    """
    keyed = reads.withColumn("_order", shuffle_key(*keys, seed=seed))
    cuts = prefix_cuts(keyed, by, "_order", _portion(ratio), nearest=True)
    return _sides(flag_prefix(keyed, cuts, by, "_order", "_first"))


def sample_assignment(reads: DataFrame, ratio: float = TRAIN_SHARE, few: int = 3, close: float = 0.05, floor: float = 0.70) -> DataFrame:
    """Side of every (cell type, sample): train, test, or split with a share.

    Types with at most ``few`` samples are split as one unit. Others try the k largest samples (by
    rows) as train, for growing k: the first k whose weight ratio is within ``close`` of the target
    and not below ``floor`` wins; failing that, the first k that reaches the target by splitting the
    heaviest test sample; failing that, the first 75% of samples by name and a part of the next.
    The result has one row per sample.
    """
    weight = read_weight(F.col("read_count")) if "read_count" in reads.columns else F.lit(1)
    s = stage(
        reads.groupBy("ctype", "sample_id").agg(F.count("*").alias("n_rows"), F.sum(weight).alias("weight")),
        "samples",
    )
    per_type = Window.partitionBy("ctype")  # one row per sample
    by_size = per_type.orderBy(F.desc("n_rows"), "sample_id")
    by_name = per_type.orderBy("sample_id")
    upto = by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = by_size.rowsBetween(1, Window.unboundedFollowing)
    s = s.select(
        "*",
        F.count("*").over(per_type).alias("n"),
        F.row_number().over(by_size).alias("k"),
        F.row_number().over(by_name).alias("place"),
        F.sum("weight").over(per_type).alias("total"),
        F.sum("weight").over(upto).alias("train_w"),
        F.max("weight").over(after).alias("next_w"),
    ).withColumn("target", F.floor(F.col("total") * ratio))
    reached = F.col("train_w") / F.col("total")
    whole = (F.col("k") < F.col("n")) & (F.abs(reached - ratio) <= close) & (reached >= floor)
    need = F.col("target") - F.col("train_w")
    partial = (
        (F.col("k") < F.col("n")) & (need > 0) & (need < F.col("next_w")) & (F.col("target") / F.col("total") >= floor)
    )
    s = s.select(
        "*",
        F.min(F.when(whole, F.col("k"))).over(per_type).alias("k_whole"),
        F.min(F.when(partial, F.col("k"))).over(per_type).alias("k_part"),
    )
    k_best = F.coalesce("k_whole", "k_part")
    # fallback: the first floor(0.75 n) samples by name
    head = F.greatest(F.floor(F.col("n") * 0.75), F.lit(1))
    in_train = F.when(k_best.isNotNull(), F.col("k") <= k_best).otherwise(F.col("place") <= head)
    s = s.withColumn("in_train", in_train)
    train_w = F.sum(F.when(F.col("in_train"), F.col("weight")).otherwise(0)).over(per_type)
    heaviest = F.min_by(
        F.when(~F.col("in_train"), F.col("sample_id")),
        F.when(~F.col("in_train"), F.struct(-F.col("weight"), F.col("k"))),
    ).over(per_type)
    split_sample = (
        F.when(F.col("k_whole").isNotNull(), F.lit(None))
        .when(F.col("k_part").isNotNull(), heaviest)
        .otherwise(F.when(F.col("place") == head + 1, F.col("sample_id")))
    )
    s = s.withColumn("needed", F.least(F.col("target") - train_w, F.col("weight"))).withColumn(
        "is_split", (F.col("sample_id") == split_sample) & ~F.col("in_train") & (F.col("needed") > 0)
    )
    few_samples = F.col("n") <= few
    return s.select(
        "ctype", "sample_id",
        F.when(few_samples | F.coalesce("is_split", F.lit(False)), F.lit("split"))
        .when(F.col("in_train"), F.lit("train")).otherwise(F.lit("test")).alias("plan"),
        F.when(few_samples, F.lit("*")).otherwise(F.col("sample_id")).alias("unit"),
        F.when(few_samples, F.lit(float(ratio))).otherwise(F.col("needed") / F.col("weight")).alias("share"),
        "n_rows",
    )


def split_by_sample(reads: DataFrame, ratio: float = TRAIN_SHARE, seed: int = SEED, **how) -> DataFrame:
    """Whole samples on one side where that meets the ratio, the rest split by sequence."""
    plan = stage(sample_assignment(reads, ratio, **how), "assignment")
    keyed = reads.withColumn("_order", shuffle_key(*SEQUENCE, seed=seed)).join(plan.drop("n_rows"), ["ctype", "sample_id"])
    groups = ["ctype", "unit"]
    split = F.col("plan") == "split"
    parts = keyed.where(split)
    # the share is the same for all samples of a unit
    sizes = plan.where(split).groupBy(*groups).agg(F.floor(F.sum("n_rows") * F.max("share")).cast("long").alias("target"))
    cuts = prefix_cuts(parts, groups, "_order", sizes, nearest=True)
    first = F.when(F.col("plan") == "split", F.col("_order") <= F.col("cut")).otherwise(F.col("plan") == "train")
    return _sides(keyed.join(cuts, groups, "left").withColumn("_first", first)).select(*reads.columns, "side")


def dedup_then_split(reads: DataFrame, ratio: float = TRAIN_SHARE, seed: int = SEED) -> DataFrame:
    """First row per sequence, count set to 1, then a random cut."""
    return split_random(keep_first(reads), ratio, seed=seed)


def dedup_cross_sample_split(reads: DataFrame, ratio: float = TRAIN_SHARE, seed: int = SEED) -> DataFrame:
    """Cross-sample de-duplication, then a random cut."""
    return split_random(dedup_cross_sample(reads), ratio, seed=seed)


def dedup_shared_split(reads: DataFrame, ratio: float = TRAIN_SHARE, seed: int = SEED, **how) -> DataFrame:
    """De-duplication of keys shared by every sample, then a random cut."""
    return split_random(stage(dedup_shared_by_all(reads, **how), "unique-reads"), ratio, seed=seed)


def apply_membership(reads: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """Rows routed to the side their key (sample, file or read name) is assigned to.

    The written assignment shows its size: a short one is broadcast and the rows stay in place.
    """
    return reads.join(stage(assignment.select(key, "side"), "membership"), key)


def split_manual(reads: DataFrame, assignment: DataFrame) -> DataFrame:
    """First row per sequence inside each sample, then the user's side per sample."""
    return apply_membership(keep_first(reads, per_sample=True), assignment, "sample_id")


def split_train_valid_test(
    reads: DataFrame, ratios: tuple[float, float, float], by: str, label: str = "ctype", seed: int = SEED, **how
) -> DataFrame:
    """Distinct values of ``by`` (read name or file) split per label in up to three parts.

    A file may hold a large share of the rows, so its rows are routed in parts (see ``skew_join``).
    """
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("ratios must sum to 1")
    if ratios[0] == 1.0:
        return reads.withColumn("side", F.lit("train"))
    items = stage(
        reads.groupBy(by).agg(F.min(label).alias("_label"), F.count("*").alias("n")).withColumn("_order", shuffle_key(by, seed=seed)),
        "names",
    )
    train = prefix_cuts(items, ["_label"], "_order", _portion(ratios[0]))
    valid = prefix_cuts(items, ["_label"], "_order", _portion(ratios[0] + ratios[1]))
    flagged = flag_prefix(flag_prefix(items, train, ["_label"], "_order", "_t"), valid, ["_label"], "_order", "_v")
    sides = flagged.select(
        by, F.when(F.col("_t"), F.lit("train")).when(F.col("_v"), F.lit("valid")).otherwise(F.lit("test")).alias("side")
    )
    return skew_join(reads, stage(sides, "membership"), [by], counts=items.select(by, "n"), **how)
