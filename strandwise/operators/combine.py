"""Combining samples, semi-joins on small sets and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from strandwise.functions.keys import SEQUENCE, content_digest
from strandwise.session import stage


def combine_samples(samples: Sequence[DataFrame]) -> DataFrame:
    """All samples as one table; columns a sample lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), samples)


def keep_known_region_types(reads: DataFrame, focus: str | None = None) -> DataFrame:
    """Rows whose region type is among the cell types seen in the input; optionally of one sample only."""
    # written first, so that the join knows how small it is and leaves the reads where they are
    seen = stage(reads.select(F.trim("ctype").alias("dmr_ctype")).where(F.col("dmr_ctype") != "").distinct(), "seen-types")
    rows = reads if focus is None else reads.where(F.col("sample_id") == focus)
    return rows.join(seen, "dmr_ctype", "left_semi").select(*reads.columns)


def types_to_process(samples: DataFrame, regions: DataFrame) -> DataFrame:
    """Samples whose cell type has regions."""
    types = stage(regions.select("cell_type").distinct(), "region-types")
    return samples.join(types, "cell_type", "left_semi")


def missing_types(samples: DataFrame, regions: DataFrame) -> DataFrame:
    """Types that have regions but no sample (``not_configured``), and the reverse (``no_regions``)."""
    configured = samples.select("cell_type").distinct()
    found = regions.select("cell_type").distinct()
    return (
        found.exceptAll(configured).withColumn("problem", F.lit("not_configured"))
        .unionByName(configured.exceptAll(found).withColumn("problem", F.lit("no_regions")))
    )


def skip_processed(work: DataFrame, done: DataFrame) -> DataFrame:
    """Work items (sample_id, dmr_label) that are not yet in the table of finished ones."""
    return work.join(done.select("sample_id", "dmr_label").distinct(), ["sample_id", "dmr_label"], "left_anti")


def leak_check(train: DataFrame, test: DataFrame, keys: Sequence[str] = SEQUENCE) -> DataFrame:
    """Number of distinct keys in train, in test and in both; one row."""
    key = content_digest(*keys).alias("_key")
    sides = (
        train.select(key, F.lit(1).alias("_in_train"), F.lit(0).alias("_in_test"))
        .unionByName(test.select(key, F.lit(0).alias("_in_train"), F.lit(1).alias("_in_test")))
        .groupBy("_key")
        .agg(F.max("_in_train").alias("_in_train"), F.max("_in_test").alias("_in_test"))
    )
    return sides.agg(
        F.sum("_in_train").alias("train_keys"),
        F.sum("_in_test").alias("test_keys"),
        F.sum(F.col("_in_train") * F.col("_in_test")).alias("shared_keys"),
    )
