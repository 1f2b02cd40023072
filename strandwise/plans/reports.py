"""Composition, audit and purity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwise.functions.keys import SEQUENCE, content_digest
from strandwise.operators import audits, mixture
from strandwise.operators.profiles import region_purity_counts
from strandwise.operators.selection import drop_uninformative
from strandwise.session import stage


def sample_composition(scored: DataFrame) -> DataFrame:
    """Composition of every sample as a whole and inside each region type, one row per class.

    ``dmr_ctype`` is null in the whole-sample rows. Both levels come from one aggregate over the reads.
    """
    top = F.array_max("probs")
    parts = scored.groupBy("sample_id", "dmr_ctype", "pred").agg(
        F.count("*").alias("_n"), F.sum(top).alias("_s")
    )
    return (
        parts.groupingSets([["sample_id", "dmr_ctype", "pred"], ["sample_id", "pred"]], "sample_id", "dmr_ctype", "pred")
        .agg(F.sum("_n").alias("n_reads"), F.round(F.sum("_s") / F.sum("_n"), 3).alias("avg_confidence"))
    )


def audit_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """All leakage figures of one train / test pair as (metric, value) rows.

    The reads are counted once per sequence digest, region, cell type and side; every figure is a sum
    over these counts, and the figures without sequences over one row per region, type and side.
    """
    hit = F.col("ctype") == F.col("dmr_ctype")
    weight = F.col("read_count").cast("long")

    def side(reads: DataFrame, is_test: bool) -> DataFrame:
        return reads.select(
            content_digest(*SEQUENCE).alias("key"), "dmr_label", "ctype", F.lit(is_test).alias("test"),
            F.coalesce(hit, F.lit(False)).cast("long").alias("hit"), weight.alias("weight"), F.when(hit, weight).otherwise(0).alias("hit_weight"),
        )

    sums = lambda *names: [F.sum(n).alias(n) for n in names]
    counts = stage(
        side(train, False).unionByName(side(test, True)).groupBy("key", "dmr_label", "ctype", "test")
        .agg(F.count("*").alias("n"), *sums("hit", "weight", "hit_weight")),
        "audit-counts",
    )
    cells = stage(counts.groupBy("dmr_label", "ctype", "test").agg(*sums("n", "hit", "weight", "hit_weight")), "audit-cells")
    in_test, known = F.sum(F.when(F.col("test"), F.col("n")).otherwise(0)), F.max(~F.col("test"))

    share = lambda part, whole: F.round(F.sum(part) / F.sum(whole), 6)
    exact = counts.groupBy("key", "dmr_label").agg(in_test.alias("t"), known.alias("known")).agg(
        share(F.when(F.col("known"), F.col("t")).otherwise(0), F.col("t")).alias("share_exact_twins")
    )
    # a label that is not the only one in train conflicts with it
    labels = counts.groupBy("key", "ctype").agg(in_test.alias("t"), known.alias("known"))
    per_key = labels.groupBy("key").agg(
        F.count_if("known").alias("labels"), F.sum("t").alias("t"), F.sum(F.when(F.col("known"), F.col("t")).otherwise(0)).alias("own")
    )
    conflict = F.when(F.col("labels") > 1, F.col("t")).when(F.col("labels") == 1, F.col("t") - F.col("own")).otherwise(0)
    pairs = per_key.agg(
        share(F.when(F.col("labels") > 0, F.col("t")).otherwise(0), F.col("t")).alias("share_twins"),
        share(conflict, F.col("t")).alias("share_conflicts"),
    )
    lookup = audits.lookup_from_counts(cells.where("NOT test"), cells.where("test"))
    target = cells.where("NOT test").agg(
        share(F.col("hit"), F.col("n")).alias("on_target_rows"), share(F.col("hit_weight"), F.col("weight")).alias("on_target_reads")
    )

    def rows(df: DataFrame, *names: str) -> DataFrame:
        listed = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        return df.select(F.explode(listed).alias("c")).select("c.metric", "c.value")

    return (
        rows(exact, "share_exact_twins")
        .unionByName(rows(pairs, "share_twins", "share_conflicts"))
        .unionByName(rows(lookup, "accuracy", "coverage"))
        .unionByName(rows(region_purity_counts(cells), "n_regions", "share_one_type", "share_all_types"))
        .unionByName(rows(target, "on_target_rows", "on_target_reads"))
    )


def tumour_purity(
    scored: DataFrame, train: DataFrame, n: int = 10_000, by_region: bool = False, second_class: bool = False,
    adjusted: bool = False,
) -> DataFrame:
    """Share of each class in a bulk sample, from informative reads only.

    ``scored`` holds ``probs`` and ``methyl_seq``; the classes of ``train`` fix their order (by name)
    and the margins. Two classes use the grid search, more the constrained maximum, to which a read gives
    the probability of its own class, or with ``second_class`` that of the second class whatever its own.

    With two classes, ``by_region`` takes the mean of the shares found inside the regions, ``adjusted`` their mean under
    weights that take the skewness out of it.
    """
    counts = train.groupBy("ctype").agg(F.count("*").alias("n")).orderBy("ctype").collect()  # one row per class
    total = sum(r["n"] for r in counts)
    margins = {r["ctype"]: r["n"] / total for r in counts}
    if len(margins) < 2:
        raise ValueError("at least two classes are needed")
    rows = drop_uninformative(scored)
    if len(margins) > 2:
        names = F.array(*[F.lit(t) for t in margins])
        # the class of a read stands for its region type
        typed = rows.select(F.get(names, F.col("true_label")).alias("dmr_ctype"), F.get("probs", F.lit(1) if second_class else F.col("true_label")).alias("p_ctype"))
        return mixture.mixture_proportions(typed.where("dmr_ctype IS NOT NULL"), margins)
    other, target = list(margins)
    pair = rows.select("*", F.get("probs", F.lit(0)).alias("p_n"), F.get("probs", F.lit(1)).alias("p_t"))
    m = (margins[other], margins[target])
    if adjusted:
        found = mixture.skewness_purity(mixture.mixture_grid_by_region(pair, m, n))
    elif by_region:
        found = mixture.mean_purity(mixture.mixture_grid_by_region(pair, m, n))
    else:
        found = mixture.mixture_grid(pair, m, n)
    # the grid walks the share of the second class
    return found.select(
        F.explode(F.array(
            F.struct(F.lit(target).alias("cell_type"), F.col("purity").alias("pred")),
            F.struct(F.lit(other).alias("cell_type"), (1.0 - F.col("purity")).alias("pred")),
        )).alias("r")
    ).select("r.*")
