"""Counts, shares and length profiles of labelled reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(100.0 * part / whole, digits)


def agreement(reads: DataFrame) -> DataFrame:
    """Rows and rows on their own type's regions per cell type, with a total row (ctype null)."""
    same = F.count_if(F.col("ctype") == F.col("dmr_ctype"))
    return reads.rollup("ctype").agg(
        F.count("*").alias("n_rows"), same.alias("n_same"), _share(same, F.count("*")).alias("pct_same")
    )


def region_type_distribution(reads: DataFrame) -> DataFrame:
    """Rows and percent per region type inside each sample."""
    counts = reads.groupBy("sample_id", "dmr_ctype").agg(F.count("*").alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy("sample_id"))
    return counts.withColumn("pct", _share(F.col("n_rows"), total))


def label_by_region(reads: DataFrame) -> DataFrame:
    """Row counts per (region, cell type), per region, per cell type and overall in one pass.

    ``level`` tells the four kinds of rows apart.
    """
    counts = reads.groupBy("dmr_label", "ctype").agg(F.count("*").alias("_n"))  # small before the expansion
    level = F.grouping_id()
    return (
        counts.groupingSets(
            [["dmr_label", "ctype"], ["dmr_label"], ["ctype"], []], "dmr_label", "ctype"
        )
        .agg(F.sum("_n").alias("n_rows"), level.alias("_level"))
        .select(
            "dmr_label", "ctype", "n_rows",
            F.element_at(F.array(*[F.lit(x) for x in ("region_type", "region", "type", "all")]), (F.col("_level") + 1).cast("int")).alias("level"),
        )
    )


def proportions(reads: DataFrame, column: str) -> DataFrame:
    """Count and percent per value of a column."""
    counts = reads.groupBy(column).agg(F.count("*").alias("n_rows"))
    # one row per value of the column: the total is taken over this small table
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", _share(F.col("n_rows"), total))


def proportion_summary(reads: DataFrame, column: str) -> DataFrame:
    """Spread of the per-value percents: mean, median, sample deviation, smallest, largest."""
    p = proportions(reads, column)
    return p.agg(
        F.count("*").alias("n_values"), F.round(F.avg("pct"), 4).alias("mean_pct"),
        F.round(F.percentile("pct", 0.5), 4).alias("median_pct"), F.round(F.stddev("pct"), 4).alias("std_pct"),
        F.min("pct").alias("min_pct"), F.max("pct").alias("max_pct"),
    )


def bands(rated: DataFrame) -> DataFrame:
    """Number of rated labels (n_rows, n_same, pct_same) per band of agreement."""
    pct = F.col("pct_same")
    band = F.when(pct >= 100, "perfect").when(pct >= 80, "high").when(pct >= 50, "moderate").otherwise("low")
    return rated.groupBy(band.alias("band")).agg(
        F.count("*").alias("n_types"), F.sum("n_rows").alias("n_rows"), F.sum("n_same").alias("n_same")
    )


def agreement_bands(reads: DataFrame) -> DataFrame:
    """Number of cell types per band of agreement."""
    return bands(agreement(reads).where(F.col("ctype").isNotNull()))


def length_counts(reads: DataFrame, column: str = "methyl_seq") -> DataFrame:
    """Rows and percent per length."""
    counts = reads.groupBy(F.length(column).cast("long").alias("length")).agg(F.count("*").alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # one row per length
    return counts.withColumn("pct", _share(F.col("n_rows"), total))


def length_profile(reads: DataFrame, column: str = "methyl_seq") -> DataFrame:
    """Count, range, mean, median and population deviation of the lengths.

    Lengths are counted first, so the exact median works on one row per length.
    """
    c = reads.groupBy(F.length(column).cast("long").alias("length")).agg(F.count("*").alias("n"))
    n, x = F.col("n"), F.col("length")
    total, first, second = F.sum(n), F.sum(n * x), F.sum(n * x * x)
    mean = first / total
    return c.agg(
        total.alias("n_rows"), F.count("*").alias("n_lengths"),
        F.min("length").alias("min_len"), F.max("length").alias("max_len"),
        F.round(mean, 4).alias("mean_len"),
        F.round(F.percentile("length", F.lit(0.5), n), 4).alias("median_len"),
        F.round(F.sqrt(F.greatest(second / total - mean * mean, F.lit(0.0))), 4).alias("std_len"),
    )


def length_histogram(reads: DataFrame, column: str = "methyl_seq", bins: int = 50) -> DataFrame:
    """Rows per equal-width length bin, the last bin closed on the right; empty bins are left out."""
    c = reads.groupBy(F.length(column).cast("long").alias("length")).agg(F.count("*").alias("n"))
    edge = Window.partitionBy(F.lit(0))  # one row per length
    low, high = F.min("length").over(edge), F.max("length").over(edge)
    spot = F.when(high == low, F.lit(0)).otherwise(
        F.least(F.floor((F.col("length") - low) * F.lit(bins) / (high - low)), F.lit(bins - 1))
    )
    return c.select(spot.cast("int").alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n_rows"))


def top_lengths(reads: DataFrame, k: int = 20, column: str = "methyl_seq") -> DataFrame:
    """The k most common lengths."""
    return length_counts(reads, column).orderBy(F.desc("n_rows"), "length").limit(k)


def region_purity_counts(reads: DataFrame) -> DataFrame:
    """Regions, share with exactly one cell type and share with all of them; one row."""
    pairs = reads.select("dmr_label", "ctype").distinct()
    types = pairs.select("ctype").distinct().count()
    return pairs.groupBy("dmr_label").agg(F.count("*").alias("_types")).agg(
        F.count("*").alias("n_regions"),
        F.round(F.avg((F.col("_types") == 1).cast("double")), 6).alias("share_one_type"),
        F.round(F.avg((F.col("_types") == types).cast("double")), 6).alias("share_all_types"),
    )


def on_target(reads: DataFrame, by: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Share of rows, and of reads weighted by count, in regions of the read's own type."""
    hit = F.col("ctype") == F.col("dmr_ctype")
    weight = F.col("read_count").cast("long")
    return reads.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.sum(weight).alias("n_reads"),
        F.count_distinct("dmr_ctype").alias("n_region_types"),
        F.round(F.avg(hit.cast("double")), 6).alias("on_target_rows"),
        F.round(F.sum(F.when(hit, weight).otherwise(0)) / F.sum(weight), 6).alias("on_target_reads"),
    )


def top_region_types(reads: DataFrame, k: int = 5) -> DataFrame:
    """Per cell type the k most frequent region types with their percent."""
    counts = reads.groupBy("ctype", "dmr_ctype").agg(F.count("*").alias("n_rows"))
    per_type = Window.partitionBy("ctype")  # as many rows as region types
    ranked = counts.withColumn("pct", _share(F.col("n_rows"), F.sum("n_rows").over(per_type))).withColumn(
        "place", F.row_number().over(per_type.orderBy(F.desc("n_rows"), "dmr_ctype")).cast("long")
    )
    return ranked.where(F.col("place") <= k)


def region_cardinality(reads: DataFrame) -> DataFrame:
    """Size a region embedding needs: distinct labels or largest label + 1, whichever is more."""
    labels = reads.select(F.col("dmr_label").cast("long").alias("l")).distinct()
    return labels.agg(F.greatest(F.count("*"), F.max("l") + 1).alias("n_regions"))


def label_index(*tables: DataFrame) -> DataFrame:
    """One shared class index over all tables: (ctype, label, n_rows), labels in name order."""
    counts = None
    for t in tables:
        part = t.groupBy("ctype").agg(F.count("*").alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    merged = counts.groupBy("ctype").agg(F.sum("n").alias("n_rows"))
    # one row per cell type
    return merged.withColumn("label", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ctype")).cast("long") - 1)


def profile_reads(reads: DataFrame) -> DataFrame:
    """Longest token sequence and range of labels over all reads; one row."""
    tokens = F.size(F.split("dna_seq", " ")).cast("long")
    label = F.col("dmr_label").cast("long")
    return reads.agg(
        F.count("*").alias("n_rows"), F.max(tokens).alias("max_tokens"),
        F.max(F.length("methyl_seq").cast("long")).alias("max_methyl"),
        F.min(label).alias("min_label"), F.max(label).alias("max_label"),
        F.count_if(tokens != F.length("methyl_seq")).alias("n_mismatched"),
    )


def split_report(sides: DataFrame, side: str = "side") -> DataFrame:
    """Per cell type the rows and shares on the train and test side and their difference."""
    counts = sides.groupBy("ctype").agg(
        F.count_if(F.col(side) == "train").alias("n_train"), F.count_if(F.col(side) == "test").alias("n_test")
    )
    everything = Window.partitionBy(F.lit(0))  # one row per cell type
    train = F.col("n_train") / F.sum("n_train").over(everything)
    test = F.col("n_test") / F.sum("n_test").over(everything)
    return counts.select(
        "ctype", "n_train", "n_test",
        F.round(100.0 * train, 4).alias("pct_train"), F.round(100.0 * test, 4).alias("pct_test"),
        F.round(100.0 * F.abs(train - test), 4).alias("pct_diff"),
    )
