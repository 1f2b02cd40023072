"""Leakage audits of a train / test pair.

Both sides are reduced to one row per key before they meet, so copies of one read never form pairs.
The keys travel as 128-bit digests, not as sequences.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strandwise.functions.keys import SEQUENCE, content_digest


def exact_twins(test: DataFrame, train: DataFrame, keys: Sequence[str] = (*SEQUENCE, "dmr_label")) -> DataFrame:
    """Share of test rows whose key also occurs in train; one row."""
    key = content_digest(*keys).alias("_key")
    n = test.groupBy(key).agg(F.count("*").alias("_n"))
    known = train.select(key).distinct().withColumn("_known", F.lit(True))
    hit = F.when(F.col("_known"), F.col("_n")).otherwise(0)
    return n.join(known, "_key", "left").agg(
        F.sum("_n").alias("n_test"), F.sum(hit).alias("n_twins"),
        F.round(F.sum(hit) / F.sum("_n"), 6).alias("share_twins"),
    )


def conflicting_twins(test: DataFrame, train: DataFrame, keys: Sequence[str] = SEQUENCE) -> DataFrame:
    """Share of test rows that have a twin in train, and a twin with another label; one row.

    Another label exists exactly when the smallest or the largest train label differs. Labels are compared
    by a 64-bit hash, because numbers can be minimised in a hash aggregate and texts cannot.
    """
    key = content_digest(*keys).alias("_key")
    label = F.xxhash64("ctype").alias("_label")
    n = test.groupBy(key, label).agg(F.count("*").alias("_n"))
    labels = train.select(key, label).groupBy("_key").agg(F.min("_label").alias("_lo"), F.max("_label").alias("_hi"))
    other = (F.col("_lo") != F.col("_label")) | (F.col("_hi") != F.col("_label"))
    twin = F.when(F.col("_lo").isNotNull(), F.col("_n")).otherwise(0)
    conflict = F.when(other, F.col("_n")).otherwise(0)
    return n.join(labels, "_key", "left").agg(
        F.sum("_n").alias("n_test"), F.sum(twin).alias("n_twins"), F.sum(conflict).alias("n_conflicts"),
        F.round(F.sum(twin) / F.sum("_n"), 6).alias("share_twins"),
        F.round(F.sum(conflict) / F.sum("_n"), 6).alias("share_conflicts"),
    )


def region_majority(train: DataFrame) -> DataFrame:
    """Most common train label per region, the first name among equals."""
    return _majority(_cells(train))


def _cells(reads: DataFrame) -> DataFrame:
    return reads.groupBy("dmr_label", "ctype").agg(F.count("*").alias("n"))


def _majority(counts: DataFrame) -> DataFrame:
    return counts.groupBy("dmr_label").agg(F.min_by("ctype", F.struct(-F.col("n"), F.col("ctype"))).alias("predicted"))


def region_lookup_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Accuracy of predicting the region's majority label, on covered test rows, and the coverage."""
    return lookup_from_counts(_cells(train), _cells(test))


def lookup_from_counts(train: DataFrame, test: DataFrame) -> DataFrame:
    """``region_lookup_baseline`` from reads ``n`` per (dmr_label, ctype)."""
    covered = F.when(F.col("predicted").isNotNull(), F.col("n")).otherwise(0)
    right = F.when(F.col("predicted") == F.col("ctype"), F.col("n")).otherwise(0)
    return test.join(_majority(train), "dmr_label", "left").agg(
        F.sum("n").alias("n_test"), F.sum(covered).alias("n_covered"),
        F.round(F.sum(right) / F.nullif(F.sum(covered), F.lit(0)), 6).alias("accuracy"),
        F.round(F.sum(covered) / F.sum("n"), 6).alias("coverage"),
    )
