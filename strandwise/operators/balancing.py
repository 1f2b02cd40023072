"""Balancing on-target against off-target reads, and class-balanced batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwise.functions.keys import SEQUENCE, content_digest, key_digest, shuffle_key
from strandwise.functions.reads import read_weight
from strandwise.operators.firsts import lead_numbers, order_numbers, rows_at
from strandwise.operators.joins import skew_join
from strandwise.operators.ordering import prefix_cuts, rank_in_group
from strandwise.session import stage

TARGET_SCHEMA = "sample_id string, group_type string, target bigint, edge bigint, taken bigint"


def sequence_groups(reads: DataFrame, order: str = "row_id") -> DataFrame:
    """One row per (sample, sequence): weight, rows, and region type, place and cell type of the first row.

    Keys travel as 16 bytes, and what is summed up comes with the first row. The rows are those of a written table.
    """
    weight = read_weight(F.col("read_count")) if "read_count" in reads.columns else F.lit(1)
    by = ["sample_id", "_key"]
    keyed = reads.select("sample_id", content_digest(*SEQUENCE).alias("_key"), order, "dmr_ctype", "ctype", weight.cast("long").alias("weight"))
    numbers = order_numbers(keyed, by, order, "weight")
    sizes = stage(lead_numbers(numbers, by, F.sum("weight").alias("weight"), F.count("*").alias("n")), "group-sizes")
    first = rows_at(keyed.drop("weight"), numbers, sizes, by, order, ["weight", "n"])
    return first.select(
        "sample_id", F.lower(F.hex("_key")).alias("seq_key"), "weight", "n",
        F.col("dmr_ctype").alias("group_type"), F.col(order).alias("first_at"), F.col("ctype").alias("first_type"),
    )


def _plan_sample(pdf: pd.DataFrame) -> pd.DataFrame:
    """Targets of one sample from its histogram (group_type, weight, groups).

    The chain over types is sequential because each type is capped by what the earlier ones really
    took. Python's round is half-even, which is the rule wanted here.
    """
    positive = int(pdf["positive"].iloc[0])
    other = pdf[pdf["group_type"] != pdf["own_type"]]
    total = int((other["weight"] * other["groups"]).sum())
    names = sorted(other["group_type"].unique())
    out, allocated = [], 0
    for name in names:
        h = other[other["group_type"] == name].sort_values("weight")
        mass = h["weight"] * h["groups"]
        have = int(mass.sum())
        want = round(have / total * positive) if name != names[-1] else positive - allocated
        want = max(0, min(want, have, positive - allocated))
        full = mass.cumsum() <= want
        below = int(mass[full].sum())
        rest = h[~full]
        edge = int(rest["weight"].iloc[0]) if len(rest) else -1
        taken = (want - below) // edge if len(rest) else 0
        allocated += below + taken * max(edge, 0)
        # every group lighter than the edge weight is taken, and `taken` groups of the edge weight
        out.append((pdf["sample_id"].iloc[0], name, want, edge if len(rest) else (1 << 62), taken))
    return pd.DataFrame(out, columns=["sample_id", "group_type", "target", "edge", "taken"])


def balance_targets(groups: DataFrame, own: DataFrame) -> DataFrame:
    """Per (sample, other type) how far the lightest-first order is followed.

    Works on the histogram of group weights: one row per distinct weight, not per group.
    """
    hist = groups.groupBy("sample_id", "group_type", "weight").agg(F.count("*").alias("groups")).join(own, "sample_id")
    per_sample = Window.partitionBy("sample_id")
    positive = F.sum(
        F.when(F.col("group_type") == F.col("own_type"), F.col("weight") * F.col("groups")).otherwise(0)
    ).over(per_sample)
    return hist.withColumn("positive", positive).where(F.col("positive") > 0).groupBy("sample_id").applyInPandas(
        _plan_sample, TARGET_SCHEMA
    )


def edges_of(hist: DataFrame, target: Callable[[Column], Column]) -> DataFrame:
    """Edge weight and number of groups taken there, for a target that depends on the type's weight only.

    ``hist`` holds (sample_id, group_type, weight, groups); its windows run over distinct weights.
    """
    group = Window.partitionBy("sample_id", "group_type")
    mass = F.col("weight") * F.col("groups")
    upto = F.sum(mass).over(group.orderBy("weight").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = hist.select("*", upto.alias("_upto"), mass.alias("_mass"), target(F.sum(mass).over(group)).alias("target"))
    beyond = F.col("_upto") > F.col("target")
    left = F.when(beyond, F.struct("weight", F.floor((F.col("target") - F.col("_upto") + F.col("_mass")) / F.col("weight")).alias("taken")))
    return rows.groupBy("sample_id", "group_type").agg(F.min(left).alias("e"), F.max("target").alias("target")).select(
        "sample_id", "group_type", "target",
        F.coalesce("e.weight", F.lit(1 << 62)).alias("edge"), F.coalesce("e.taken", F.lit(0)).cast("long").alias("taken"),
    )


def off_target_prefix(groups: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Lightest-first groups per (sample, type) while their summed weight stays within the target.

    Equal weights are ordered by a seeded hash. All groups below the edge weight are taken; of those
    at the edge weight, exactly ``taken``, found by a prefix cut.
    """
    keyed = groups.withColumn("_order", shuffle_key("seq_key", seed=seed)).join(targets, ["sample_id", "group_type"])
    by = ["sample_id", "group_type"]
    limits = targets.select(*by, F.col("taken").alias("target"))
    cuts = prefix_cuts(keyed.where(F.col("weight") == F.col("edge")), by, "_order", limits)
    taken = (F.col("weight") < F.col("edge")) | ((F.col("weight") == F.col("edge")) & (F.col("_order") <= F.col("cut")))
    return keyed.join(cuts, by, "left").where(taken).select(*groups.columns)


def balance_on_target(reads: DataFrame, order: str = "row_id", seed: int = 42, **how) -> DataFrame:
    """Per sample all on-target sequence groups and off-target groups of about the same weight.

    A sample's type is that of its first row. Off-target weight is shared out over the other types in
    proportion to their weight, each in name order, lightest groups first. Samples without on-target
    weight stay whole.
    """
    groups = sequence_groups(reads, order)
    # one row per sample: small enough to be sent to the groups from here on
    per_type = stage(
        groups.groupBy("sample_id", "group_type").agg(F.sum("weight").alias("weight"), F.min(F.struct("first_at", "first_type")).alias("first")), "type-weights"
    )
    own = per_type.groupBy("sample_id").agg(F.min("first").alias("first")).select("sample_id", F.col("first.first_type").alias("own_type"))
    is_own = F.col("group_type") == F.col("own_type")
    positive = F.sum(F.when(is_own, F.col("weight")).otherwise(0)).alias("positive")
    own = stage(per_type.join(own, "sample_id").groupBy("sample_id", "own_type").agg(positive), "own-types")
    targets = stage(balance_targets(groups, own.select("sample_id", "own_type")), "targets")
    whole = groups.join(own, "sample_id").where(is_own | (F.col("positive") == 0)).select(*groups.columns)
    # a group that both parts name is still one key of the semi join
    digest = key_digest(F.col("seq_key")).alias("_key")
    keep = whole.unionByName(off_target_prefix(groups, targets, seed)).select("sample_id", digest)
    keyed = reads.withColumn("_key", content_digest(*SEQUENCE))
    return skew_join(
        keyed, keep, ["sample_id", "_key"], "left_semi", spread=[order],
        counts=groups.select("sample_id", digest, "n"), **how,
    ).select(*reads.columns)


def balanced_batches(
    reads: DataFrame, batch_size: int, label: str = "ctype", key: Sequence[str] = ("row_id",),
    drop_last: bool = False, seed: int = 42,
) -> DataFrame:
    """Batches holding the same number of rows of every class.

    The smallest class fixes the number of batches; each class is walked in a hash order and starts
    over when it runs out. Adds ``batch`` and ``slot``.
    """
    keyed = reads.withColumn("_order", shuffle_key(*key, seed=seed))
    sizes = stage(keyed.groupBy(label).agg(F.count("*").alias("_n")), "sizes")
    classes, smallest = sizes.agg(F.count("*"), F.min("_n")).first()
    if not classes:
        raise ValueError("no rows to batch")
    quota = max(1, batch_size // classes)
    batches = smallest // quota if drop_last else -(-smallest // quota)
    used = batches * quota
    # rows beyond the used ones are cut away before anything is ranked
    cuts = prefix_cuts(keyed, [label], "_order", lambda total: F.least(total, F.lit(used)))
    needed = stage(keyed.join(cuts, label).where(F.col("_order") <= F.col("cut")).drop("cut"), "batch-rows")
    ranked = rank_in_group(needed, [label], "_order", "_rank", largest=used).join(sizes, label)
    # place r, r + n, r + 2n, ... of the walk; at most one extra round, in a class below `used`
    rounds = F.floor((F.lit(used) - F.col("_rank")) / F.col("_n"))
    walk = ranked.withColumn("_round", F.explode(F.sequence(F.lit(0), rounds)))
    place = F.col("_rank") - 1 + F.col("_round") * F.col("_n")
    return walk.withColumn("batch", F.floor(place / quota)).withColumn("slot", place % quota).drop(
        "_order", "_rank", "_n", "_round"
    )
