"""Incremental sample ingestion and running composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strandwise.plans.build_reads import assemble
from strandwise.functions.naming import sample_of_path
from strandwise.functions.reads import kmers
from strandwise.operators.intervals import overlap_fragments
from strandwise.operators.joins import dealt
from strandwise.sources.readers import PAT_SCHEMA, clean_fragments, union_all


def stream_fragments(spark: SparkSession, folder: str, files_per_batch: int = 64, span: str = "called") -> DataFrame:
    """PAT files as they arrive in ``folder``, each picked up once."""
    raw = spark.readStream.schema(PAT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).csv(folder, sep="\t")
    name = sample_of_path(F.col("_metadata.file_path"))
    return clean_fragments(raw.select(name.alias("sample_id"), "*"), span)


BUCKETS = 64  # of samples; a merge rewrites those with new reads
JOURNAL = "upto bigint, buckets int, rewritten array<int>"


def ingest_samples(
    fragments: DataFrame, samples: DataFrame, marked_regions: DataFrame, out: str, checkpoint: str,
    compact_every: int = 0, buckets: int = BUCKETS, **how,
) -> StreamingQuery:
    """Turn arriving fragments into counted reads and add them to the table in the folder ``out``.

    Every micro-batch runs the batch plan against the prepared regions (``build_reads.prepare_regions``,
    kept as a written table) and sums up its own reads. Files of one sample may arrive in any batches:
    ``read_ingested`` adds their counts, so the result does not depend on the size of a batch.
    Each batch writes its own folder, so a batch replayed after a failure replaces itself.

    With ``compact_every``, a batch that finds so many closed ones before it folds them first (see ``compact``).
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        if compact_every:
            folded, _, _ = journal(batch.sparkSession, out)
            if batch_id - 1 - folded >= compact_every:  # the batches before this one are closed
                compact(batch.sparkSession, out, batch_id - 1, buckets)
        spread = dealt(batch.join(samples, "sample_id"))  # arriving files may be ones that cannot be split
        reads = assemble(overlap_fragments(spread, marked_regions, **how))
        _collapsed(reads).write.mode("overwrite").parquet(f"{out}/open/batch={batch_id}")

    return (
        fragments.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _collapsed(reads: DataFrame) -> DataFrame:
    return reads.groupBy("sample_id", "bases", "methyl_seq", "dmr_label", "ctype", "dmr_ctype").agg(
        F.sum("read_count").alias("read_count")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def journal(spark: SparkSession, out: str) -> tuple[int, int, dict[int, int]]:
    """The last batch that is folded (-1: none), the number of buckets, and the version of every bucket.

    A merge becomes visible by its line in the journal, which is written last: one small file, in one rename.
    """
    if not _exists(spark, f"{out}/journal"):
        return -1, BUCKETS, {}
    lines = spark.read.schema(JOURNAL).json(f"{out}/journal")
    last, buckets = lines.agg(F.max("upto"), F.max("buckets")).first()
    if last is None:
        return -1, BUCKETS, {}
    versions = lines.select("upto", F.explode("rewritten").alias("bucket")).groupBy("bucket").agg(F.max("upto").alias("v"))
    return last, buckets, {r["bucket"]: r["v"] for r in versions.collect()}  # one row per bucket


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("sample_id"), F.lit(buckets)).cast("int")


def _open(spark: SparkSession, out: str, after: int, upto: int | None = None) -> DataFrame | None:
    """Reads of the batches that are not folded; folders of other batches are not read."""
    if not _exists(spark, f"{out}/open"):
        return None
    rows = spark.read.parquet(f"{out}/open").where(F.col("batch") > after)
    return rows if upto is None else rows.where(F.col("batch") <= upto)


def _folded(spark: SparkSession, out: str, versions: dict[int, int]) -> DataFrame | None:
    """The current version of the given buckets; folders of others are not read."""
    if not versions:
        return None
    by_version: dict[int, list[int]] = {}
    for bucket, v in versions.items():
        by_version.setdefault(v, []).append(bucket)
    current = F.lit(False)
    for v, held in by_version.items():
        current = current | ((F.col("v") == v) & F.col("bucket").isin(held))
    return spark.read.parquet(f"{out}/folded").where(current)


def _touched(rows: DataFrame, buckets: int) -> list[int]:
    return sorted(r[0] for r in rows.select(_bucket(buckets).alias("b")).distinct().collect())  # at most one row per bucket


def compact(spark: SparkSession, out: str, upto: int, buckets: int = BUCKETS) -> None:
    """Fold the batches up to ``upto``, which must be closed, into buckets of samples.

    Only buckets with reads in those batches are merged and written, as a new version beside the old one. A merge that
    fails before its journal line leaves files that nobody reads and that the next try replaces. A batch that is
    replayed after it was folded is not read again, so it counts once.
    """
    after, known, versions = journal(spark, out)
    buckets = known if versions or after >= 0 else buckets
    fresh = _open(spark, out, after, upto) if upto > after else None
    if fresh is None:
        return
    touched = _touched(fresh, buckets)
    if touched:
        rows = fresh.drop("batch").withColumn("bucket", _bucket(buckets))
        before = _folded(spark, out, {b: v for b, v in versions.items() if b in set(touched)})
        if before is not None:
            rows = rows.unionByName(before.drop("v"))
        merged = _collapsed(rows).withColumn("bucket", _bucket(buckets)).withColumn("v", F.lit(upto))
        merged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(f"{out}/folded")
    line = spark.createDataFrame([(upto, buckets, touched)], JOURNAL).coalesce(1)
    line.write.mode("append").json(f"{out}/journal")


def read_ingested(spark: SparkSession, out: str) -> DataFrame:
    """Labelled reads of all batches so far, one row per distinct read.

    Buckets without reads in open batches come as they were folded; only the others are summed up again.
    """
    after, buckets, versions = journal(spark, out)
    fresh = _open(spark, out, after)
    touched = set(_touched(fresh, buckets)) if fresh is not None else set()
    still = _folded(spark, out, {b: v for b, v in versions.items() if b not in touched})
    merged = _folded(spark, out, {b: v for b, v in versions.items() if b in touched})
    columns = ["sample_id", "bases", "methyl_seq", "dmr_label", "ctype", "dmr_ctype", "read_count"]
    parts = [p.select(*columns) for p in (fresh, merged) if p is not None]
    found = [] if still is None else [still.select(*columns)]
    if touched:  # else no batch is open
        found.append(_collapsed(union_all(parts)))
    if not found:
        if fresh is None:
            raise ValueError(f"{out} holds no batch yet")
        found.append(fresh.select(*columns))  # batches without reads
    return union_all(found).select(
        "sample_id", kmers(F.col("bases")).alias("dna_seq"), "methyl_seq", "dmr_label", "ctype", "dmr_ctype", "read_count"
    )


def running_composition(scored: DataFrame) -> DataFrame:
    """Reads per sample and called class over an unbounded scored stream (update or complete mode)."""
    return scored.groupBy("sample_id", "pred").agg(F.count("*").alias("n_reads"))
