"""Readers and writers: tables are written in each input format and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandwise.catalog import query, views as V
from strandwise.functions.reads import kmers
from strandwise.operators import metrics
from strandwise.operators.scoring import score_reads
from strandwise.session import scratch_path
from strandwise.sources import readers as S, writers as W

R = V.KEYED_SQL


@query("read_fragments", f"SELECT sample_id, chr, cpg_start, pattern, read_count, cpg_end FROM ({V.FRAGMENTS_END_SQL}) f")
def read_fragments(spark, sf):
    """Gzipped PAT text, one folder per sample."""
    path = scratch_path(spark, "pat")
    V.raw_fragments(spark, sf).withColumnRenamed("sample_id", "sample").write.partitionBy("sample").csv(path, sep="\t", compression="gzip")
    rows = S.read_fragments(spark, path)
    return rows.select(F.col("sample").alias("sample_id"), "chr", "cpg_start", "pattern", "read_count", "cpg_end")


@query("read_cpg_index", V.CPG_SQL)
def read_cpg_index(spark, sf):
    path = scratch_path(spark, "cpg")
    index = V.cpg_index(spark, sf)
    remark = F.when(F.col("cpg_idx") % 1000 == 0, F.concat(F.lit("# note "), F.col("cpg_idx").cast("string")))
    line = F.concat_ws("\t", "chr", F.col("pos").cast("string"), F.col("cpg_idx").cast("string"))
    index.select(F.explode(F.array_compact(F.array(remark, line))).alias("value")).write.text(path)
    return S.read_cpg_index(spark, path)


@query("read_regions", """
SELECT p_partkey AS dmr_label, chr, p_partkey * 45 + 1 AS "start", p_partkey * 45 + 40 + p_size * 3 AS "end", p_partkey * 7 AS cpg_start, p_partkey * 7 + p_size % 12 AS cpg_end, cell_type
FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'chrX' ELSE 'chr' || CAST(p_partkey % 5 + 1 AS VARCHAR) END AS chr, 'T' || CAST(p_size % 8 AS VARCHAR) AS cell_type FROM part) p
WHERE chr <> 'chrX'""")
def read_regions(spark, sf):
    """CSV files in key order; the label is the row number, also past dropped chromosomes."""
    path = scratch_path(spark, "regions")
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "chrX").otherwise(F.concat(F.lit("chr"), (k % 5 + 1).cast("string"), F.lit("_alt")))
    rows = V.table(spark, sf, "part").select(
        name.alias("chr"), (k * 45 + 1).alias("start"), (k * 45 + 40 + F.col("p_size") * 3).alias("end"), (k * 7).alias("startCpG"),
        (k * 7 + F.col("p_size") % 12).alias("endCpG"), F.concat(F.lit("T"), (F.col("p_size") % 8).cast("string")).alias("Type"),
    )
    rows.repartitionByRange("start").sortWithinPartitions("start").write.csv(path, header=True)
    return S.read_regions(spark, path)


@query("bed_round_trip", """SELECT 'chr' || CAST(p_partkey % 5 + 1 AS VARCHAR) AS chr, p_partkey * 45 + 1 AS "start", p_partkey * 45 + 40 + p_size * 3 AS "end", p_brand AS name FROM part""")
def bed_round_trip(spark, sf):
    """A column that is null in every row is not written."""
    path = scratch_path(spark, "bed")
    rows = V.markers(spark, sf).join(V.table(spark, sf, "part").select(F.col("p_partkey").alias("dmr_label"), F.col("p_brand").alias("name")), "dmr_label")
    kept = W.write_bed(rows.select("chr", "start", "end", F.lit(None).cast("string").alias("score"), "name"), path)
    return S.read_bed(spark, path, kept)


@query("read_reference", f"""
WITH c AS (SELECT chr || '_' || CAST(chunk_id // 256 AS VARCHAR) AS chr, string_agg(seq, '' ORDER BY chunk_id) AS t FROM ({V.GENOME_SQL}) g GROUP BY chr, chunk_id // 256),
k AS (SELECT chr, t, unnest(range(0, (length(t) + 49) // 50)) AS chunk_id FROM c)
SELECT chr, chunk_id, substr(t, chunk_id * 50 + 1, 50) AS seq FROM k""")
def read_reference(spark, sf):
    """FASTA lines of 32 bases re-cut into chunks of 50; every contig is a stretch of a chromosome."""
    path = scratch_path(spark, "fasta")
    contig = F.concat_ws("_", "chr", F.floor(F.col("chunk_id") / 256).cast("string"))
    lines = V.genome(spark, sf).select(contig.alias("contig"), F.col("chunk_id").alias("_at"), F.lower("seq").alias("value"))
    heads = lines.select("contig").distinct().select("contig", F.lit(-1).alias("_at"), F.concat(F.lit(">"), F.col("contig"), F.lit(" view")).alias("value"))
    heads.unionByName(lines).repartition("contig").sortWithinPartitions("contig", "_at").select("value").write.text(path)
    return S.read_reference(spark, path, 50)


LABELLED_SQL = f"SELECT {V.KMER_SQL.format('dna_seq')} AS dna_seq, methyl_seq, CAST(dmr_label AS VARCHAR) AS dmr_label, ctype, dmr_ctype, CAST(read_count AS VARCHAR) AS read_count"


def _labelled(spark, sf):
    return V.keyed_reads(spark, sf).withColumn("dna_seq", kmers(F.col("dna_seq")))


@query("read_labelled_reads", f"{LABELLED_SQL} FROM ({R}) r")
def read_labelled_reads(spark, sf):
    """Semicolons and foreign header names; files of two kinds, with the columns in two orders."""
    path = scratch_path(spark, "labelled")
    columns = [
        F.col("read_count").alias("Read_Count"), F.col("dna_seq").alias("DNA_sequence"), F.col("methyl_seq").alias("MethylSeq"),
        F.col("dmr_label").alias("DMR_Label"), F.col("ctype").alias("Cell_type"), F.col("dmr_ctype").alias("DMR_cType"), "lane",
    ]
    first = F.col("dmr_label") % 2 == 0
    rows = _labelled(spark, sf)
    rows.where(first).select(*columns).write.csv(path, sep=";", header=True)
    rows.where(~first).select(*columns[::-1]).write.mode("append").csv(path, sep="\t", header=True)
    return S.read_labelled_reads(spark, path, with_region_type=True)


def _call_model():
    """A fixed scorer standing for the user's model: the classes are the shares of the three call states."""

    def predict(pdf):
        calls = pdf["methyl_seq"]
        return np.stack([calls.str.count(c) / calls.str.len() for c in "012"], axis=1)

    return predict


@query("compose_unlabelled", f"""
WITH s AS (SELECT list_transform(['0', '1', '2'], lambda c: CAST(length(methyl_seq) - length(replace(methyl_seq, c, '')) AS DOUBLE) / length(methyl_seq)) AS x FROM ({R}) r),
p AS (SELECT list_transform(x, lambda v: exp(v) / list_sum(list_transform(x, lambda y: exp(y)))) AS probs FROM s),
q AS (SELECT probs, list_position(probs, list_max(probs)) - 1 AS pred FROM p)
SELECT 'cfdna' AS sample_id, i - 1 AS class, round(avg(probs[i]), 6) AS mean_prob, row_number() OVER (ORDER BY avg(probs[i]) DESC, i) AS place,
 count(*) FILTER (pred = i - 1) AS n_called, count(*) AS n_reads FROM (SELECT probs, pred, unnest(range(1, 4)) AS i FROM q) u GROUP BY i""")
def compose_unlabelled(spark, sf):
    """Reads without a cell type: three columns are read, scored and pooled into one call."""
    path = scratch_path(spark, "unlabelled")
    _labelled(spark, sf).select(
        F.col("dna_seq").alias("DNA_seq"), F.col("methyl_seq").alias("Methyl_seq"), F.col("dmr_label").alias("DMR_Label")
    ).write.csv(path, header=True)
    rows = S.read_labelled_reads(spark, path, labelled=False).withColumn("sample_id", F.lit("cfdna"))
    return metrics.pooled_call(score_reads(rows, _call_model, ["methyl_seq"]))


@query("read_sectioned", f"{LABELLED_SQL}, sample_id || '.pat.gz' AS sample_id FROM ({R}) r")
def read_sectioned(spark, sf):
    path = scratch_path(spark, "sectioned")
    W.write_sectioned(V.keyed_reads(spark, sf), path, bases=True)
    return S.read_sectioned(spark, path).drop("row_no")


@query("read_alignments", """
SELECT o_orderkey AS qname, CASE o_custkey % 3 WHEN 0 THEN 0 ELSE 16 END AS flag, 'chr' || CAST(o_custkey % 5 + 1 AS VARCHAR) AS chr, o_orderkey * 10 AS pos,
 o_orderkey * 10 + CASE o_custkey % 2 WHEN 0 THEN 32 ELSE 27 END AS pos_end, md5('x' || CAST(o_orderkey AS VARCHAR)) AS xm FROM orders WHERE o_custkey % 4 <> 1 AND o_custkey % 3 <> 1""")
def read_alignments(spark, sf):
    """SAM text with header lines, duplicates and reads without a call tag."""
    path = scratch_path(spark, "sam")
    k, key = F.col("o_custkey"), F.col("o_orderkey").cast("string")
    record = F.concat_ws(
        "\t", key, F.when(k % 3 == 0, "0").when(k % 3 == 1, "1024").otherwise("16"),
        F.concat(F.lit("chr"), (k % 5 + 1).cast("string")), (F.col("o_orderkey") * 10 + 1).cast("string"), F.lit("60"),
        F.when(k % 2 == 0, "32M").otherwise("2S27M3S3H"), F.lit("*\t0\t0"), F.md5(key), F.lit("*\tNM:i:0"),
        F.when(k % 4 != 1, F.concat(F.lit("XM:Z:"), F.md5(F.concat(F.lit("x"), key)))).otherwise("XG:Z:CT"),
    )
    head = F.when(F.col("o_orderkey") % 100 == 0, F.lit("@CO a comment"))
    V.table(spark, sf, "orders").select(F.explode(F.array_compact(F.array(head, record))).alias("value")).write.text(path)
    rows = S.read_alignments(spark, path)
    return rows.select(F.col("qname").cast("bigint").alias("qname"), "flag", "chr", "pos", "pos_end", "xm")


@query("read_run_logs", f"SELECT 'log=' || run AS run, step, loss, acc FROM ({V.RUN_EVAL_SQL}) e")
def read_run_logs(spark, sf):
    path = scratch_path(spark, "logs")
    V.run_eval(spark, sf).withColumnRenamed("run", "log").write.partitionBy("log").csv(path, sep="\t", header=True)
    return S.read_run_logs(spark, path).select("run", "step", "loss", "acc")


@query("read_manifest", """
SELECT s_name AS sample_key, s_name || '.pat.gz' AS pat_file, s_name || '.csv' AS output_file, 'T' || CAST(s_nationkey AS VARCHAR) AS cell_type, 'genome.fa' AS fasta_file FROM supplier""")
def read_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    entry = F.struct(
        F.concat("s_name", F.lit(".pat.gz")).alias("pat_file"), F.concat("s_name", F.lit(".csv")).alias("output_file"),
        F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("cell_type"),
    )
    doc = F.struct(F.lit("genome.fa").alias("fasta_file"), F.create_map("s_name", entry).alias("cell_types"))
    V.table(spark, sf, "supplier").select(F.to_json(doc).alias("value")).write.text(path)
    return S.read_manifest(spark, path, multiline=False).select("sample_key", "pat_file", "output_file", "cell_type", "fasta_file")


@query("read_manifest_mixed", """
SELECT CASE s_suppkey % 3 WHEN 1 THEN s_name ELSE s_name || CAST(s_suppkey % 3 AS VARCHAR) END AS sample_key, s_name || '.pat.gz' AS pat_file, CASE WHEN s_suppkey % 3 <> 2 THEN s_name || '.csv' END AS output_file,
 CASE s_suppkey % 3 WHEN 0 THEN 'T' || CAST(s_nationkey AS VARCHAR) WHEN 1 THEN s_name END AS cell_type, CASE s_suppkey % 3 WHEN 1 THEN s_name || '.regions.csv' ELSE 'markers.csv' END AS csv_file,
 CASE s_suppkey % 3 WHEN 1 THEN 'own.fa' ELSE 'genome.fa' END AS fasta_file, s_suppkey % 3 <> 1 AS collective FROM supplier""")
def read_manifest_mixed(spark, sf):
    """Collective documents with objects or bare paths, and documents that map a cell type to its own files, in one folder."""
    path = scratch_path(spark, "manifests")
    k, pat = F.col("s_suppkey") % 3, F.concat("s_name", F.lit(".pat.gz"))
    key = F.concat("s_name", k.cast("string"))
    whole = lambda value: F.struct(F.lit("markers.csv").alias("collective_csv_file"), F.lit("genome.fa").alias("fasta_file"), F.create_map(key, value).alias("cell_types"))
    entry = F.struct(pat.alias("pat_file"), F.concat("s_name", F.lit(".csv")).alias("output_file"), F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("cell_type"))
    own = F.struct(F.concat("s_name", F.lit(".regions.csv")).alias("csv_file"), pat.alias("pat_file"), F.lit("own.fa").alias("fasta_file"), F.concat("s_name", F.lit(".csv")).alias("output_file"))
    text = F.when(k == 0, F.to_json(whole(entry))).when(k == 1, F.to_json(F.create_map("s_name", own))).otherwise(F.to_json(whole(pat)))
    V.table(spark, sf, "supplier").select(text.alias("value")).write.text(path)
    return S.read_manifest(spark, path, multiline=False).drop("collective_csv_file", "cpg_bed_file")


@query("manifest_from_names", """
SELECT 'GSM' || CAST(p_partkey AS VARCHAR) || '_Blood_T_Z' || CAST(p_size AS VARCHAR) || '_hg38' AS sample_key,
 'GSM' || CAST(p_partkey AS VARCHAR) || '_Blood-T-Z' || CAST(p_size AS VARCHAR) || '.hg38.pat.gz' AS pat_file,
 'GSM' || CAST(p_partkey AS VARCHAR) || '_Blood-T-Z' || CAST(p_size AS VARCHAR) || '.hg38.csv' AS output_file, 'CTC' AS cell_type FROM part""")
def manifest_from_names(spark, sf):
    stem = F.concat(F.lit("GSM"), F.col("p_partkey").cast("string"), F.lit("_Blood-T-Z"), F.col("p_size").cast("string"), F.lit(".hg38"))
    listing = F.concat(F.lit("-rw-r--r-- "), stem, F.lit(".pat.gz\n  "), stem, F.lit(".pat.gz.csi "), stem, F.lit(".beta"))
    return S.manifest_from_names(V.table(spark, sf, "part").select(listing.alias("name")))


@query("write_split", f"""SELECT dna_seq, methyl_seq, ctype, dmr_label, CASE WHEN row_id < 'c' THEN 'train' ELSE 'test' END AS side FROM ({R}) r""")
def write_split(spark, sf):
    path = scratch_path(spark, "split")
    rows = V.keyed_reads(spark, sf).withColumn("side", F.when(F.col("row_id") < "c", "train").otherwise("test"))
    W.write_split(rows.select("dna_seq", "methyl_seq", "ctype", "dmr_label", "side"), path)
    return spark.read.csv(path, sep="\t", header=True, schema="dna_seq string, methyl_seq string, ctype string, dmr_label bigint, side string")


@query("write_composition", f"""
SELECT sample_id, pred, n_reads, round(100.0 * n_reads / sum(n_reads) OVER (PARTITION BY sample_id), 2) AS pct FROM (
 SELECT sample_id, CAST(pred AS INT) AS pred, count(*) AS n_reads FROM ({V.PROBS_SQL}) p GROUP BY ALL) g""")
def write_composition(spark, sf):
    path = scratch_path(spark, "composition")
    W.write_composition(metrics.composition(V.scored(spark, sf)), path)
    return spark.read.schema("sample_id string, pred int, n_reads bigint, pct double").json(path)


@query("read_family_schemes", """
SELECT 'Method ' || CAST(p_size % 5 AS VARCHAR) AS scheme, p_brand AS family, 'type ' || CAST(p_partkey AS VARCHAR) || part AS ctype
FROM part, (VALUES ('a'), ('b')) x(part)""")
def read_family_schemes(spark, sf):
    """Text with a title line per part of a scheme."""
    path = scratch_path(spark, "schemes")
    key = F.col("p_partkey").cast("string")
    member = F.concat(F.lit("- "), F.col("p_brand"), F.lit(": type "), key, F.lit("a, type "), key, F.lit("b"))
    title = F.concat(F.lit("Method "), (F.col("p_size") % 5).cast("string"))
    rows = V.table(spark, sf, "part").select(F.explode(F.array(title, member, F.lit(""))).alias("value"))
    rows.write.text(path)
    return S.read_family_schemes(spark, path)
