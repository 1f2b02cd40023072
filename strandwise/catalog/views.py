"""The operators' inputs, shaped deterministically from the given tables.

Each view exists twice: as a Spark plan and as SQL text for the checks. The tables hold no
methylation data, so patterns, bases and labels are drawn from hashes of their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwise.functions.coords import fragment_end
from strandwise.operators.genome import index_cpgs
from strandwise.operators.ordering import rank_positions

CHUNK = 32  # bases per genome chunk of the view


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- fragments -----------------------------------------------------------------------------------

FRAGMENTS_SQL = """
SELECT 's' || CAST(l_suppkey % 8 AS VARCHAR) AS sample_id, 'chr' || CAST(l_partkey % 5 + 1 AS VARCHAR) AS chr,
 l_orderkey AS cpg_start,
 translate(substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), 1, 2 + CAST(l_quantity AS INT) % 9), '0123456789abcdef', 'CCCCCCCTTTTTTT..') AS pattern,
 l_linenumber AS read_count FROM lineitem
"""
FRAGMENTS_END_SQL = f"""
SELECT *, cpg_start + length(regexp_replace(pattern, '[^CT]', '', 'g')) - 1 AS cpg_end
FROM ({FRAGMENTS_SQL}) f WHERE regexp_matches(pattern, '[CT]')
"""


def raw_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = (F.lit(2) + F.col("l_quantity").cast("int") % 9).cast("int")
    text = F.md5(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 8).cast("string")).alias("sample_id"),
        F.concat(F.lit("chr"), (F.col("l_partkey") % 5 + 1).cast("string")).alias("chr"),
        F.col("l_orderkey").alias("cpg_start"),
        F.translate(F.substring(text, F.lit(1), length), "0123456789abcdef", "CCCCCCCTTTTTTT..").alias("pattern"),
        F.col("l_linenumber").alias("read_count"),
    )


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_fragments(spark, sf_dir)
    return raw.where(F.col("pattern").rlike("[CT]")).withColumn(
        "cpg_end", fragment_end(F.col("cpg_start"), F.col("pattern"))
    )


# --- marker regions, in CpG space and in bases ----------------------------------------------------

REGIONS_SQL = """
SELECT p_partkey AS dmr_label, 'chr' || CAST(p_partkey % 5 + 1 AS VARCHAR) AS chr,
 p_partkey * 7 AS cpg_start, p_partkey * 7 + p_size % 12 AS cpg_end,
 CASE WHEN p_size % 10 = 0 THEN 'T1:T2' ELSE 'T' || CAST(p_size % 8 AS VARCHAR) END AS cell_type FROM part
"""
MARKERS_SQL = """
SELECT p_partkey AS dmr_label, 'chr' || CAST(p_partkey % 5 + 1 AS VARCHAR) AS chr,
 p_partkey * 45 + 1 AS "start", p_partkey * 45 + 40 + p_size * 3 AS "end",
 CASE WHEN p_size % 10 = 0 THEN 'T1:T2' ELSE 'T' || CAST(p_size % 8 AS VARCHAR) END AS cell_type FROM part
"""


def _region_type():
    return F.when(F.col("p_size") % 10 == 0, F.lit("T1:T2")).otherwise(
        F.concat(F.lit("T"), (F.col("p_size") % 8).cast("string"))
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("dmr_label"),
        F.concat(F.lit("chr"), (F.col("p_partkey") % 5 + 1).cast("string")).alias("chr"),
        (F.col("p_partkey") * 7).alias("cpg_start"),
        (F.col("p_partkey") * 7 + F.col("p_size") % 12).alias("cpg_end"),
        _region_type().alias("cell_type"),
    )


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("dmr_label"),
        F.concat(F.lit("chr"), (F.col("p_partkey") % 5 + 1).cast("string")).alias("chr"),
        (F.col("p_partkey") * 45 + 1).alias("start"),
        (F.col("p_partkey") * 45 + 40 + F.col("p_size") * 3).alias("end"),
        _region_type().alias("cell_type"),
    )


# --- genome and CpG index -------------------------------------------------------------------------

GENOME_SQL = """
SELECT 'chr' || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS chr, CAST(floor(o_orderkey / 5.0) AS BIGINT) AS chunk_id,
 translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq FROM orders
"""
CPG_SQL = """
SELECT chr, pos, row_number() OVER (ORDER BY chr, pos) AS cpg_idx FROM
 (SELECT DISTINCT 'chr' || CAST(o_custkey % 5 + 1 AS VARCHAR) AS chr, o_orderkey * 3 + o_custkey % 3 AS pos FROM orders) t
"""
GENOME_CPG_SQL = f"""
SELECT chr, pos, row_number() OVER (ORDER BY chr, pos) AS cpg_idx FROM (
 SELECT chr, chunk_id * 32 + i AS pos FROM (
  SELECT g.chr, g.chunk_id, g.seq || coalesce(left(n.seq, 1), '') AS t, unnest(range(1, 33)) AS i
  FROM ({GENOME_SQL}) g LEFT JOIN ({GENOME_SQL}) n ON n.chr = g.chr AND n.chunk_id = g.chunk_id + 1) u
 WHERE substr(t, i, 2) = 'CG') v
"""


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("chr"), (F.col("o_orderkey") % 5 + 1).cast("string")).alias("chr"),
        F.floor(F.col("o_orderkey") / 5).cast("bigint").alias("chunk_id"),
        F.translate(F.md5(F.col("o_orderkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGN").alias("seq"),
    )


def cpg_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("chr"),
        (F.col("o_orderkey") * 3 + F.col("o_custkey") % 3).alias("pos"),
    ).distinct()
    return rank_positions(points, "chr", "pos", "cpg_idx")


def genome_cpgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_cpgs(genome(spark, sf_dir), CHUNK)


# --- labelled reads -------------------------------------------------------------------------------

# row_id: a hash of the columns that tell the rows of the table apart
ROW_ID_SQL = (
    "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y-%m-%d')))"
)
READS_SQL = f"""
SELECT row_id, 's' || CAST(t AS VARCHAR) || '-' || CAST(l_suppkey % (1 + t % 5) AS VARCHAR) AS sample_id,
 'r' || CAST(l_suppkey % (1 + t % 5) AS VARCHAR) AS lane,
 translate(md5(CAST(seed AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS dna_bases,
 substr(translate(md5('m' || CAST(seed AS VARCHAR) || '-' || CAST(l_linenumber % 3 AS VARCHAR)), '0123456789abcdef', '0011222222222222'), 1, 30) AS methyl_seq,
 seed % 40 AS dmr_label, 'T' || CAST(t AS VARCHAR) AS ctype, 'T' || CAST(seed % 40 % 9 AS VARCHAR) AS dmr_ctype,
 1 + l_linenumber % 2 AS read_count
FROM (SELECT *, {ROW_ID_SQL} AS row_id, CASE WHEN l_suppkey % 4 = 0 THEN l_linenumber % 8 ELSE seed % 8 END AS t
      FROM (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN l_partkey % 500 ELSE l_orderkey + 1000 END AS seed FROM lineitem) a) b
"""
# 3-mers of the 32 bases
KMER_SQL = "array_to_string(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)), ' ')"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_partkey") % 500).otherwise(F.col("l_orderkey") + 1000)
    row_id = F.md5(F.concat_ws(
        "|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), F.col("l_shipdate").cast("date").cast("string"),
    ))
    base = table(spark, sf_dir, "lineitem").withColumn("seed", seed).withColumn(
        "t", F.when(F.col("l_suppkey") % 4 == 0, F.col("l_linenumber") % 8).otherwise(F.col("seed") % 8)
    )
    lane = (F.col("l_suppkey") % (1 + F.col("t") % 5)).cast("string")
    t = F.col("t").cast("string")
    s = F.col("seed").cast("string")
    mark = F.md5(F.concat(F.lit("m"), s, F.lit("-"), (F.col("l_linenumber") % 3).cast("string")))
    return base.select(
        row_id.alias("row_id"),
        F.concat(F.lit("s"), t, F.lit("-"), lane).alias("sample_id"),
        F.concat(F.lit("r"), lane).alias("lane"),
        F.translate(F.md5(s), "0123456789abcdef", "ACGTACGTACGTACGT").alias("dna_bases"),
        F.substring(F.translate(mark, "0123456789abcdef", "0011222222222222"), 1, 30).alias("methyl_seq"),
        (F.col("seed") % 40).alias("dmr_label"),
        F.concat(F.lit("T"), t).alias("ctype"),
        F.concat(F.lit("T"), (F.col("seed") % 40 % 9).cast("string")).alias("dmr_ctype"),
        (F.lit(1) + F.col("l_linenumber") % 2).alias("read_count"),
    )


def keyed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose bases stand for the DNA part of the key; 3-mers are spelled out only where needed."""
    return reads(spark, sf_dir).withColumnRenamed("dna_bases", "dna_seq")


KEYED_SQL = f"SELECT row_id, sample_id, lane, dna_bases AS dna_seq, methyl_seq, dmr_label, ctype, dmr_ctype, read_count FROM ({READS_SQL}) r"


# --- scored reads and run logs --------------------------------------------------------------------

SCORED_SQL = """
SELECT vec_id AS read_id, 's' || CAST(vec_id % 5 AS VARCHAR) AS sample_id, 'T' || CAST(vec_id % 4 AS VARCHAR) AS dmr_ctype,
 label AS true_label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS logits FROM embeddings
"""
PROBS_SQL = f"""
SELECT *, list_position(probs, list_max(probs)) - 1 AS pred, list_max(probs) AS max_prob FROM (
 SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM (
  SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM ({SCORED_SQL}) a) b) c
"""
RUN_EVAL_SQL = """
SELECT 'r' || CAST(user_id % 20 AS VARCHAR) AS run, event_id AS step, value AS loss,
 CAST(event_id * 37 % 1000 AS DOUBLE) / 1000 AS acc FROM events
"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("read_id"),
        F.concat(F.lit("s"), (F.col("vec_id") % 5).cast("string")).alias("sample_id"),
        F.concat(F.lit("T"), (F.col("vec_id") % 4).cast("string")).alias("dmr_ctype"),
        F.col("label").alias("true_label"),
        F.col("embedding").cast("array<double>").alias("logits"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.operators.scoring import with_probabilities

    return with_probabilities(logits(spark, sf_dir))


def run_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string")).alias("run"),
        F.col("event_id").alias("step"), F.col("value").alias("loss"),
        ((F.col("event_id") * 37 % 1000).cast("double") / 1000).alias("acc"),
    )
