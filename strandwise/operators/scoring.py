"""Batch scoring with a user-supplied model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from strandwise.functions import vectors


def score_reads(reads: DataFrame, make_predict: Callable, inputs: list[str], batch: int = 4096) -> DataFrame:
    """Logits, probabilities and the called class for every read.

    ``make_predict()`` runs once per task and returns a function from a pandas frame of the ``inputs``
    columns to a (rows x classes) array of logits, so a model is loaded once and not per batch. The
    softmax is applied once, on the JVM side.
    """
    schema = T.StructType([*reads.schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch].copy()
                part["logits"] = list(np.asarray(predict(part[inputs]), dtype=float))
                yield part

    scored = reads.mapInPandas(run, schema).withColumn("probs", vectors.softmax(F.col("logits")))
    return scored.withColumn("pred", vectors.argmax(F.col("probs")))


def with_probabilities(scored: DataFrame, logits: str = "logits") -> DataFrame:
    """Add probabilities and the called class to rows that already hold logits."""
    return scored.withColumn("probs", vectors.softmax(F.col(logits))).withColumn("pred", vectors.argmax(F.col("probs")))
