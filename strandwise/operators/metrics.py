"""Scores of classified reads: quality, confidence, losses, priors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from strandwise.functions import vectors

EPS = 1e-8


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """Rows per (true, predicted) class."""
    return scored.groupBy("true_label", "pred").agg(F.count("*").alias("n"))


def class_report(scored: DataFrame) -> DataFrame:
    """Per class seen in truth or prediction: support, predicted, correct, precision, recall, F1."""
    cells = confusion_matrix(scored)
    hit = F.when(F.col("true_label") == F.col("pred"), F.col("n")).otherwise(0)
    sides = (
        cells.select(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"), hit.alias("correct"))
        .unionByName(cells.select(F.col("pred").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("correct")))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "correct")])
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return sides.select(
        "*",
        ratio(F.col("correct"), F.col("predicted")).alias("precision"),
        ratio(F.col("correct"), F.col("support")).alias("recall"),
        ratio(2 * F.col("correct"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def classification_metrics(scored: DataFrame) -> DataFrame:
    """Accuracy, macro F1 over classes seen in truth or prediction, weighted F1; one row."""
    return class_report(scored).agg(
        F.sum("support").alias("n_reads"),
        F.round(F.sum("correct") / F.sum("support"), 6).alias("accuracy"),
        F.round(F.avg("f1"), 6).alias("f1_macro"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("f1_weighted"),
    )


def composition(scored: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Count, percent and confidence per predicted class inside each group, with the dominant class.

    The dominant class is the most frequent one, the lowest label among equals.
    """
    top = F.col("max_prob")
    rows = scored.withColumn("max_prob", vectors.max_prob(F.col("probs")))
    per_class = rows.groupBy(*by, "pred").agg(
        F.count("*").alias("n_reads"), F.avg(top).alias("_avg"), F.stddev_pop(top).alias("_std"),
        F.min(top).alias("_min"), F.max(top).alias("_max"),
    )
    group = Window.partitionBy(*by)  # one row per class
    best = F.min_by("pred", F.struct(-F.col("n_reads"), F.col("pred"))).over(group)
    return per_class.select(
        *by, "pred", "n_reads",
        F.round(100.0 * F.col("n_reads") / F.sum("n_reads").over(group), 2).alias("pct"),
        F.round("_avg", 3).alias("avg_confidence"), F.round("_std", 3).alias("std_confidence"),
        F.round("_min", 3).alias("min_confidence"), F.round("_max", 3).alias("max_confidence"),
        (F.col("pred") == best).alias("is_dominant"),
    )


def composition_verdict(scored: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """One row per group: reads, dominant class and its percent, overall confidence and deviation."""
    top = vectors.max_prob(F.col("probs"))
    # sums of the per-class rows give the overall figures without a second pass over the reads
    per_class = scored.groupBy(*by, "pred").agg(
        F.count("*").alias("_n"), F.sum(top).alias("_s"), F.sum(top * top).alias("_s2")
    )
    n, mean = F.sum("_n"), F.sum("_s") / F.sum("_n")
    return per_class.groupBy(*by).agg(
        n.alias("n_reads"),
        F.min_by("pred", F.struct(-F.col("_n"), F.col("pred"))).alias("dominant"),
        F.round(100.0 * F.max("_n") / n, 2).alias("dominant_pct"),
        F.round(mean, 3).alias("avg_confidence"),
        F.round(F.sqrt(F.greatest(F.sum("_s2") / n - mean * mean, F.lit(0.0))), 3).alias("std_confidence"),
    )


def composition_by_region_type(scored: DataFrame) -> DataFrame:
    """Composition inside each region type; types are numbered by name."""
    parts = composition(scored, ("dmr_ctype",))
    # a table with one row per (region type, class)
    number = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("dmr_ctype")) - 1
    return parts.select(F.concat(F.lit("Region_"), number.cast("string")).alias("region"), "*")


def pooled_call(scored: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Mean probability vector per group as one row per class, its rank, and the class's own calls.

    Probabilities are summed by position on the map side: a group travels as one row per class.
    """
    means = (
        scored.select(*by, F.posexplode("probs").alias("class", "p"), "pred")
        .groupBy(*by, "class")
        .agg(F.avg("p").alias("_mean"), F.count_if(F.col("pred") == F.col("class")).alias("n_called"), F.count("*").alias("n_reads"))
    )
    place = Window.partitionBy(*by).orderBy(F.desc("_mean"), "class")
    return means.select(
        *by, F.col("class").cast("long").alias("class"), F.round("_mean", 6).alias("mean_prob"), F.row_number().over(place).cast("long").alias("place"),
        "n_called", "n_reads",
    )


def class_weights(reads: DataFrame, label: str = "ctype") -> DataFrame:
    """Inverse-frequency weights with mean 1, and the weights of the one-vs-rest focal loss."""
    counts = reads.groupBy(label).agg(F.count("*").alias("n_rows"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    inverse = 1.0 / (F.col("n_rows") + EPS)
    share = F.col("n_rows") / F.sum("n_rows").over(every)
    return counts.select(
        label, "n_rows",
        F.round(inverse / F.avg(inverse).over(every), 6).alias("weight"),
        F.round(F.greatest(F.least(1.0 - share, F.lit(0.9)), F.lit(0.6)), 6).alias("alpha_pos"),
        F.lit(1.0).alias("alpha_neg"),
    )


def class_priors(reads: DataFrame, link: str = "log", label: str = "ctype", floor: float = 1e-4) -> DataFrame:
    """Share per class and its log or logit after clamping."""
    if link not in ("log", "logit"):
        raise ValueError(f"link must be 'log' or 'logit', got {link!r}")
    counts = reads.groupBy(label).agg(F.count("*").alias("n_rows"))
    share = F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # one row per class
    p = F.greatest(F.least(share, F.lit(1.0 - floor)), F.lit(floor))
    value = F.log(p) if link == "log" else F.log(p / (1.0 - p))
    return counts.select(label, "n_rows", F.round(share, 6).alias("prior"), F.round(value, 6).alias("bias"))


def per_class_confidence(scored: DataFrame) -> DataFrame:
    """Per true class: reads, accuracy and mean probability given to the true class."""
    own = F.get("probs", F.col("true_label"))
    return scored.groupBy("true_label").agg(
        F.count("*").alias("n_reads"),
        F.round(F.avg((F.col("pred") == F.col("true_label")).cast("double")), 6).alias("accuracy"),
        F.round(F.avg(own), 6).alias("confidence"),
    )


def loss_metrics(
    scored: DataFrame, gamma: float = 2.0, weights: Sequence[float] | None = None,
    alpha_pos: Sequence[float] | None = None, alpha_neg: Sequence[float] | None = None, ovr_gamma: float = 1.0,
) -> DataFrame:
    """Mean cross-entropy, softmax focal loss and one-vs-rest focal loss; one row."""
    z, y = F.col("logits"), F.col("true_label")
    return scored.agg(
        F.count("*").alias("n_reads"),
        F.round(F.avg(vectors.cross_entropy(z, y, weights)), 6).alias("cross_entropy"),
        F.round(F.avg(vectors.focal_loss(z, y, gamma, weights)), 6).alias("focal"),
        F.round(F.avg(vectors.one_vs_rest_focal_loss(z, y, ovr_gamma, alpha_pos, alpha_neg)), 6).alias("focal_one_vs_rest"),
    )
