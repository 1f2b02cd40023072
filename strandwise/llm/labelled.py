"""Which labelled rows may be learned from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5


def held_out(doc_id: str | Column) -> Column:
    """Is the row kept for testing: crc32 of its id as text, modulo 5, is 0? Null ids are not."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_labels(labels: DataFrame, label: Column, doc_id: str = "doc_id") -> DataFrame:
    """``id, label``: one row per id that may be learned from; the largest label where an id has several."""
    rows = labels.select(F.col(f"`{doc_id}`").alias("id"), label.cast("int").alias("label"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL").where(~held_out("id"))
    return rows.groupBy("id").agg(F.max("label").alias("label"))


def sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``id, label``, chosen by the hash of the id."""
    return labels.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(rows)
