"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, contaminated documents go,
sources are mixed to their weights, and the mix is written as token records.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and reads it back for the next one. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwise.llm import decontamination, mixing, shingle_join, token_records, toxicity
from strandwise.session import stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half. Learns from the labels of this stage's documents."""
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that word shingles link, and all that link with none."""
    return shingle_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that the mix takes a document; where a budget ends, a document's first words."""
    return mixing.apply_mix(mixing.mix(docs, mixing.word_count(F.col("text")), out="_mix"), out="_mix")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token records and returns what is read back: doc_id, start, n_tokens, ids_crc32."""
    manifest = token_records.write_records(docs, token_records.new_folder(docs))
    return token_records.read_records(manifest).select(F.col("key").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_records", token_output),
]

ORACLE_SQL = None  # language models and the tokenizer are beyond SQL; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
