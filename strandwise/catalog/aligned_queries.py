"""Aligned reads against regions and genome as one plan: SAM text in, training reads out."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.catalog import query, views as V
from strandwise.functions import alignments as AL
from strandwise.operators.naming_styles import chromosome_aliases, harmonise
from strandwise.operators.selection import pick_regions
from strandwise.plans.aligned_reads import aligned_reads, aligned_training
from strandwise.session import scratch_path
from strandwise.sources import readers as S

#: kind -> CIGAR, bases of the read, aligned bases, reference bases, its calls laid out along the reference
KINDS = (
    ("24M", 24, 24, 24, "xm"), ("4S20M", 24, 20, 20, "substr(xm, 5)"), ("10M2I8M", 20, 20, 18, "substr(xm, 1, 10) || substr(xm, 13, 8)"),
    ("8M3D9M", 17, 17, 20, "substr(xm, 1, 8) || 'DDD' || substr(xm, 9)"), ("6M4N6M", 12, 12, 16, "substr(xm, 1, 6) || 'DDDD' || substr(xm, 7)"),
    ("3H12=2X6=", 20, 20, 20, "xm"),
)


def _by_kind(values) -> str:
    return "CASE l_partkey % 6 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


QNAME = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"
ALIGNED_SQL = f"""
SELECT *, CASE WHEN flag & 1 = 1 THEN (flag & 16 <> 0) <> (flag & 64 <> 0) ELSE flag & 16 = 0 END AS top,
 {_by_kind(k[4] for k in KINDS)} AS calls FROM (
 SELECT {QNAME} AS qname, 'T' || CAST(l_orderkey % 4 AS VARCHAR) AS ctype, 'chr' || CAST(l_partkey % 5 + 1 AS VARCHAR) AS chr, l_partkey, l_orderkey * 6 + l_linenumber * 5 AS pos,
  CASE l_suppkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 65 WHEN 3 THEN 81 WHEN 4 THEN 129 ELSE 1024 END AS flag,
  substr(translate(md5('x' || {QNAME}), '0123456789abcdef', 'zzzzzzzZZZZZZ..x'), 1, {_by_kind(k[1] for k in KINDS)}) AS xm FROM lineitem) l WHERE flag <> 1024"""


def _reads_sql(span: str, regions: str) -> str:
    """Every read and region, base by base."""
    size = _by_kind(k[2 if span == "query" else 3] for k in KINDS)
    hole = "repeat('N', 32)"
    return f"""
genome AS MATERIALIZED ({V.GENOME_SQL}),
spots AS ({regions}),
aligned AS (SELECT a.*, {size} AS n FROM ({ALIGNED_SQL}) a),
met AS (SELECT a.*, s.dmr_id, s.dmr_ctype FROM aligned a JOIN spots s ON s.chr = a.chr AND a.pos >= s."start" AND a.pos + a.n <= s."end"),
cut AS (SELECT m.*, substr(coalesce(g.seq, {hole}) || coalesce(h.seq, {hole}), pos % 32 + 1, n) AS ref FROM met m
 LEFT JOIN genome g ON g.chr = m.chr AND g.chunk_id = m.pos // 32 LEFT JOIN genome h ON h.chr = m.chr AND h.chunk_id = m.pos // 32 + 1),
raw AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN substr(ref, i, 2) <> 'CG' THEN substr(ref, i, 1) WHEN i > length(calls) THEN 'C'
  WHEN top THEN substr(calls, i, 1) WHEN i + 1 > length(calls) THEN 'C' ELSE substr(calls, i + 1, 1) END) AS r FROM cut WHERE ref LIKE '%CG%' AND regexp_matches(xm, '[zZ]')),
called AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN substr(ref, i, 2) = 'CG' AND (r[i] IN ('.', 'D') OR (r[i] = 'x' AND substr(calls, i, 2) LIKE '%D%')) THEN 'C' ELSE r[i] END) AS d FROM raw),
bases AS (SELECT *, array_to_string(d, '') AS b FROM called WHERE NOT list_contains(d, 'x') AND (list_contains(d, 'z') OR list_contains(d, 'Z'))),
reads AS (SELECT qname AS name, ctype, chr, pos, flag, array_to_string(list_transform(range(1, length(b) - 2), lambda i: substr(translate(b, 'zZx', 'CCC'), i, 3)), ' ') AS dna_seq,
 array_to_string(list_transform(range(1, length(b) - 2), lambda i: CASE substr(b, i + 1, 1) WHEN 'z' THEN '0' WHEN 'Z' THEN '1' ELSE '2' END), '') AS methyl_seq,
 dmr_id AS dmr_label, dmr_ctype FROM bases)"""


SPOTS_SQL = f'SELECT dmr_label AS dmr_id, chr, "start", "end", cell_type AS dmr_ctype FROM ({V.MARKERS_SQL}) m'


def _spots(spark, sf):
    """Markers named 1, 2, ... where the genome has chr1, chr2, ..."""
    return V.markers(spark, sf).select(
        F.col("dmr_label").alias("dmr_id"), F.substring("chr", 4, 10).alias("chr"), "start", "end", F.col("cell_type").alias("ctype")
    )


def _sam(spark, sf):
    """SAM text in the short style of names, read back; the cell type is drawn from the read's name."""
    path = scratch_path(spark, "sam")
    kind, k = F.col("l_partkey") % 6, F.col("l_suppkey") % 6
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    chosen = lambda at: F.element_at(F.array(*[F.lit(row[at]) for row in KINDS]), (kind + 1).cast("int"))
    xm = F.substring(F.translate(F.md5(F.concat(F.lit("x"), name)), "0123456789abcdef", "zzzzzzzZZZZZZ..x"), F.lit(1), chosen(1))
    flag = F.when(k == 0, "0").when(k == 1, "16").when(k == 2, "65").when(k == 3, "81").when(k == 4, "129").otherwise("1024")
    record = F.concat_ws(
        "\t", name, flag, (F.col("l_partkey") % 5 + 1).cast("string"), (F.col("l_orderkey") * 6 + F.col("l_linenumber") * 5 + 1).cast("string"),
        F.lit("60"), chosen(0), F.lit("*\t0\t0"), F.repeat(F.lit("A"), chosen(1)), F.lit("*"), F.concat(F.lit("XM:Z:"), xm),
    )
    V.table(spark, sf, "lineitem").select(record.alias("value")).write.text(path)
    return S.read_alignments(spark, path).withColumn("ctype", F.concat(F.lit("T"), (F.split("qname", "-")[0].cast("long") % 4).cast("string")))


@query("aligned_reads", f"WITH {_reads_sql('query', SPOTS_SQL)} SELECT * FROM reads")
def aligned_reads_query(spark, sf):
    """Insertions, skipped stretches, mismatches and clips; a read ends after its aligned bases."""
    return aligned_reads(_sam(spark, sf), _spots(spark, sf), V.genome(spark, sf), V.CHUNK)


@query("aligned_reads_by_reference", f"WITH {_reads_sql('reference', SPOTS_SQL)} SELECT * FROM reads")
def aligned_reads_by_reference(spark, sf):
    """The same with the reference span of a read, which moves reads over the ends of regions."""
    return aligned_reads(_sam(spark, sf), _spots(spark, sf), V.genome(spark, sf), V.CHUNK, span="reference")


PICKED_SQL = f"""
SELECT *, row_number() OVER (ORDER BY first_stat DESC, first_row, statistic DESC, dmr_label) - 1 AS dmr_id FROM (
 SELECT *, max(statistic) OVER (PARTITION BY cell_type) AS first_stat, first_value(dmr_label) OVER (PARTITION BY cell_type ORDER BY statistic DESC, dmr_label) AS first_row,
  row_number() OVER (PARTITION BY cell_type ORDER BY statistic DESC, dmr_label) AS place FROM (SELECT *, dmr_label * 37 % 1009 AS statistic FROM ({V.MARKERS_SQL}) m) s) t WHERE place <= {{}}"""


def _ranked(spark, sf):
    spots = _spots(spark, sf).withColumnRenamed("dmr_id", "row_no")
    return spots.withColumn("statistic", (F.col("row_no") * 37 % 1009).cast("double"))


@query("pick_regions", f"SELECT dmr_id, cell_type AS ctype, dmr_label AS row_no FROM ({PICKED_SQL.format(7)}) p")
def pick_regions_query(spark, sf):
    return pick_regions(_ranked(spark, sf), 7).select("dmr_id", "ctype", "row_no")


@query("aligned_training", f"""
WITH picked AS ({PICKED_SQL.format(100)}),
{_reads_sql('query', 'SELECT dmr_id, chr, "start", "end", cell_type AS dmr_ctype FROM picked')},
names AS (SELECT name, min(ctype) AS label FROM reads GROUP BY name),
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(name || '|42')) AS k, count(*) OVER (PARTITION BY label) AS n FROM names)
SELECT r.*, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'valid' ELSE 'test' END AS side FROM reads r JOIN placed p ON p.name = r.name""")
def aligned_training_query(spark, sf):
    """The hundred best regions of every type, names split in three per cell type."""
    return aligned_training(_sam(spark, sf), _ranked(spark, sf), V.genome(spark, sf), V.CHUNK, 100, (0.6, 0.2, 0.2))


NAMES_SQL = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'chr' || CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'MT' WHEN 3 THEN 'chrx' ELSE 'un' || CAST(p_size AS VARCHAR) END AS chr FROM part"
STYLES = [f"chr{i}" for i in range(1, 31)] + ["31", "32", "chr32", "chrM", "X"]


def _named(spark, sf):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit("chr"), size)).when(k == 1, size).when(k == 2, "MT").when(k == 3, "chrx").otherwise(F.concat(F.lit("un"), size))
    return V.table(spark, sf, "part").select("p_partkey", name.alias("chr"))


ALIAS_SQL = f"""
WITH rows AS ({NAMES_SQL}), styles AS (SELECT unnest({STYLES}) AS alias),
keyed AS (SELECT DISTINCT chr, CASE WHEN k = 'MT' THEN 'M' ELSE k END AS k FROM (SELECT chr, upper(regexp_replace(chr, '^(chr)(.)', '\\2', 'i')) AS k FROM rows) r),
known AS (SELECT alias, CASE WHEN k = 'MT' THEN 'M' ELSE k END AS k FROM (SELECT alias, upper(regexp_replace(alias, '^(chr)(.)', '\\2', 'i')) AS k FROM styles) s),
best AS (SELECT chr, arg_min(alias, [CASE WHEN chr = alias THEN '0' ELSE '1' END, alias]) AS alias FROM keyed JOIN known USING (k) GROUP BY chr)
"""


@query("chromosome_aliases", f"{ALIAS_SQL} SELECT chr, alias FROM best")
def chromosome_aliases_query(spark, sf):
    return chromosome_aliases(_named(spark, sf), spark.createDataFrame([(s,) for s in STYLES], "chr string"))


@query("harmonise_names", f"{ALIAS_SQL} SELECT p_partkey, coalesce(alias, chr) AS chr FROM rows LEFT JOIN best USING (chr)")
def harmonise_names(spark, sf):
    return harmonise(_named(spark, sf), spark.createDataFrame([(s,) for s in STYLES], "chr string"))


@query("read_statistics_regions", """
SELECT chr, p_partkey * 45 AS "start", p_partkey * 45 + p_size AS "end", ctype, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / CASE p_partkey % 3 WHEN 1 THEN 1 ELSE 100 END END AS statistic
FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'chr7' WHEN 1 THEN '12' WHEN 2 THEN 'chrX' ELSE '3' END AS chr, 'T' || CAST(p_size % 8 AS VARCHAR) AS ctype FROM part) p WHERE chr <> 'chrX'""")
def read_statistics_regions(spark, sf):
    """Files with an area statistic (and a difference beside it), with a difference alone, and with neither; either style of names."""
    path = scratch_path(spark, "statistics")
    k, size = F.col("p_partkey"), F.col("p_size")
    part = V.table(spark, sf, "part").select(
        k, F.when(k % 4 == 0, "chr7").when(k % 4 == 1, "12").when(k % 4 == 2, "chrX").otherwise("3").alias("chr"), (k * 45).alias("start"), (k * 45 + size).alias("end"),
        F.concat(F.lit("T"), (size % 8).cast("string")).alias("ctype"), F.when(k % 2 == 0, -size).otherwise(size).alias("s"),
    )
    spots = ["chr", "start", "end", "ctype"]
    files = (
        part.where(k % 3 == 1).select(*spots, F.lit(0.5).alias("diff.Methy"), F.col("s").alias("areaStat")),
        part.where(k % 3 == 2).select(F.col("ctype"), "chr", "start", "end", (F.col("s") / 100).alias("diff.Methy")),
        part.where(k % 3 == 0).select(*spots),
    )
    for rows in files:
        rows.write.mode("append").csv(path, header=True, sep="\t")
    return S.read_statistics_regions(spark, path).drop("row_no")


SPAN_SQL = _by_kind(f"{k[2]} * 1000 + {k[3]}" for k in KINDS)


@query("alignment_spans", f"SELECT l_orderkey, l_linenumber, l_partkey, CAST({SPAN_SQL} // 1000 AS BIGINT) AS aligned, CAST({SPAN_SQL} % 1000 AS BIGINT) AS spanned FROM lineitem")
def alignment_spans(spark, sf):
    cigar = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), (F.col("l_partkey") % 6 + 1).cast("int"))
    rows = V.table(spark, sf, "lineitem").withColumn("cigar", cigar)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", AL.query_length(F.col("cigar")).alias("aligned"), AL.reference_length(F.col("cigar")).alias("spanned"))
