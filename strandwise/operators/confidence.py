"""Most and least confident reads, best classes per read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandwise.functions import vectors
from strandwise.session import stage


BIN_DECIMALS = 3  # decimals to which vectors are compared, and the width of a confidence bin


def extreme_candidates(scored: DataFrame, low_k: int, high_k: int) -> DataFrame:
    """Reads in the confidence bins that can hold a class's ``low_k`` least or ``high_k`` most confident vectors.

    A bin is a rounded confidence. That number is part of the rounded vector, so all reads of a vector share a bin and
    every bin with reads holds a vector of its own: the first k bins of a class hold at least k vectors. Nothing but
    (class, bin) is shuffled to find them; candidates are filtered where they are.
    """
    rows = scored.select("read_id", "true_label", "pred", "probs", vectors.max_prob(F.col("probs")).alias("confidence"))
    rows = rows.where(F.col("confidence").isNotNull()).withColumn("_bin", F.round("confidence", BIN_DECIMALS))
    bins = F.sort_array(F.collect_list("_bin"))  # at most 1,001 per class
    listed = rows.select("true_label", "_bin").distinct().groupBy(F.col("true_label").alias("_class")).agg(bins.alias("_bins"))
    cuts = stage(
        listed.select(
            "_class", F.get("_bins", F.least(F.lit(low_k), F.size("_bins")) - 1).alias("_low"),
            F.get("_bins", F.greatest(F.size("_bins") - high_k, F.lit(0))).alias("_high"),
        ),
        "bin-cuts",
    )
    rounded = F.array_join(F.transform("probs", lambda p: F.round(p, BIN_DECIMALS).cast("string")), "|")
    inside = (F.col("_bin") <= F.col("_low")) | (F.col("_bin") >= F.col("_high"))
    return rows.join(cuts, F.col("true_label").eqNullSafe(F.col("_class"))).where(inside).select(
        "read_id", "true_label", "pred", "probs", "confidence", F.unhex(F.md5(rounded.cast("binary"))).alias("_vector")
    )


def confidence_extremes(scored: DataFrame, low_k: int = 15, high_k: int = 15, shown: int = 4) -> DataFrame:
    """Per true class the least and most confident reads, one per rounded probability vector.

    Among reads with one vector the least (most) confident stands for it, the smaller read id among
    equals. Both ends come from one pass over the candidates (see ``extreme_candidates``): digests, confidences and ids
    are ranked, and vectors are looked up for the winners only. ``classes`` and ``class_probs`` list the best classes,
    with the true class appended when it is not among them. Reads without probabilities are left out.
    """
    found = stage(extreme_candidates(scored, low_k, high_k), "extreme-candidates")
    key = ["true_label", "_vector"]
    slim = found.select(*key, "confidence", "read_id")
    ends = slim.groupBy(*key).agg(F.min("confidence").alias("_low"), F.max("confidence").alias("_high"))
    met = slim.join(ends.withColumnsRenamed({c: f"_{c}" for c in key}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    least = lambda end: F.min(F.when(F.col("confidence") == F.col(end), F.col("read_id")))
    ends = stage(
        met.groupBy(*key, "_low", "_high").agg(least("_low").alias("_low_id"), least("_high").alias("_high_id")), "extreme-vectors"
    )
    parts = []
    for kind, k, sign in (("low", low_k, 1.0), ("high", high_k, -1.0)):
        place = Window.partitionBy("true_label").orderBy(sign * F.col(f"_{kind}"), f"_{kind}_id")
        ranked = ends.withColumn("place", F.row_number().over(place).cast("long")).where(F.col("place") <= k)
        parts.append(ranked.select(
            F.lit(kind).alias("kind"), "place", F.col("true_label").alias("_class"), F.col("_vector").alias("_of"), F.col(f"_{kind}_id").alias("_id")
        ))
    picks = stage(parts[0].unionByName(parts[1]), "extreme-picks")  # k rows per class and kind
    same = F.col("true_label").eqNullSafe(F.col("_class")) & (F.col("_vector") == F.col("_of")) & (F.col("read_id") == F.col("_id"))
    rows = found.join(picks, same).dropDuplicates(["kind", "true_label", "place"])
    best = F.transform(vectors.top_k(F.col("probs"), shown), lambda s: s["class"])
    listed = F.when(F.array_contains(best, F.col("true_label")), best).otherwise(
        F.concat(best, F.array(F.col("true_label")))
    )
    return rows.select(
        "kind", "true_label", "place", "read_id", "pred", "confidence",
        F.array_join(F.transform(listed, lambda c: c.cast("string")), " ").alias("classes"),
        F.transform(listed, lambda c: F.get("probs", c)).alias("class_probs"),
    )


def confidence_summary(extremes: DataFrame) -> DataFrame:
    """Examples, mean, smallest and largest confidence per kind and class."""
    return extremes.groupBy("kind", "true_label").agg(
        F.count("*").alias("n_examples"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.round(F.min("confidence"), 6).alias("min_confidence"), F.round(F.max("confidence"), 6).alias("max_confidence"),
    )


def top_classes(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k best classes of every read with their probabilities, one row each."""
    return scored.select(
        "read_id", F.posexplode(vectors.top_k(F.col("probs"), k)).alias("place", "c")
    ).select("read_id", (F.col("place") + 1).cast("long").alias("place"), F.col("c.class").alias("class"), F.col("c.prob").alias("prob"))
