"""Reference slices, CpG index, genome windows and the full read build."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.catalog import query, views as V
from strandwise.catalog.interval_queries import IMPUTE_SQL
from strandwise.functions import alignments as AL
from strandwise.operators import genome as G, profiles
from strandwise.operators.joins import dealt
from strandwise.plans.build_reads import build_reads, extract_reads, prepare_regions
from strandwise.session import scratch_path, stage
from strandwise.streaming.ingest import ingest_samples, read_ingested, stream_fragments

def _slice_sql(genome: str) -> str:
    return f"""
SELECT m.dmr_label, any_value(m.chr) AS chr, any_value(m."start") AS "start", any_value(m."end") AS "end",
 upper(substr(string_agg(rpad(coalesce(g.seq, ''), 32, 'N'), '' ORDER BY m.chunk_id), CAST(any_value(m."start") - min(m.chunk_id) * 32 AS BIGINT), any_value(m."end" - m."start") + 1)) AS ref_seq,
 any_value(m.cell_type) AS cell_type
FROM (SELECT *, unnest(range((m."start" - 1) // 32, (m."end" - 1) // 32 + 1)) AS chunk_id FROM ({V.MARKERS_SQL}) m) m
LEFT JOIN ({genome}) g ON g.chr = m.chr AND g.chunk_id = m.chunk_id GROUP BY m.dmr_label HAVING count(g.seq) > 0
"""


SLICE_SQL = _slice_sql(V.GENOME_SQL)


@query("slice_reference", SLICE_SQL)
def slice_reference(spark, sf):
    return G.slice_reference(V.markers(spark, sf), V.genome(spark, sf), V.CHUNK)


@query("slice_reference_holes", _slice_sql(f"SELECT * FROM ({V.GENOME_SQL}) g WHERE chunk_id % 3 <> 1"))
def slice_reference_holes(spark, sf):
    """Every third chunk is absent: at the start, in the middle and at the end of spans."""
    return G.slice_reference(V.markers(spark, sf), V.genome(spark, sf).where("chunk_id % 3 <> 1"), V.CHUNK)


@query("index_cpgs", V.GENOME_CPG_SQL)
def index_cpgs(spark, sf):
    return V.genome_cpgs(spark, sf)


@query("genome_windows", f"""
WITH c AS (SELECT *, chunk_id - row_number() OVER (PARTITION BY chr ORDER BY chunk_id) AS island FROM ({V.GENOME_SQL}) g WHERE seq NOT LIKE '%N%'),
i AS (SELECT chr, min(chunk_id) AS first, string_agg(seq, '' ORDER BY chunk_id) AS t FROM c GROUP BY chr, island),
w AS (SELECT chr, first, unnest(range(0, length(t) // 20)) AS w, t FROM i)
SELECT chr, first * 32 + w * 20 + 1 AS "start", {V.KMER_SQL.format('s').replace('length(s) - 1', 'length(s) - 2')} AS kmers FROM (SELECT *, substr(t, w * 20 + 1, 20) AS s FROM w) x""")
def genome_windows(spark, sf):
    return G.genome_windows(V.genome(spark, sf), V.CHUNK, length=20)


BUILD_SQL = f"""
WITH cpg AS MATERIALIZED ({V.GENOME_CPG_SQL}), s AS MATERIALIZED ({SLICE_SQL}), frag AS MATERIALIZED ({V.FRAGMENTS_END_SQL}),
m AS MATERIALIZED (SELECT s.dmr_label, s.chr, s."start" AS a, s."end" AS z, s.cell_type, s.ref_seq AS ref, min(c.cpg_idx) AS lo_idx, max(c.cpg_idx) AS hi_idx,
  list({{'pos': c.pos, 'idx': c.cpg_idx}} ORDER BY c.pos) FILTER (c.pos > s."start" AND c.pos < s."end") AS cpgs
  FROM s JOIN cpg c ON c.chr = s.chr AND c.pos BETWEEN s."start" AND s."end" GROUP BY ALL),
p AS (SELECT f.sample_id, f.cpg_start, f.read_count, {IMPUTE_SQL} AS filled, m.*, list_filter(cpgs, lambda c: c.idx BETWEEN f.cpg_start AND f.cpg_end) AS cov
  FROM frag f JOIN m ON f.chr = m.chr AND f.cpg_start <= m.hi_idx AND m.lo_idx <= f.cpg_end),
q AS (SELECT *, cov[1].pos - a AS c1, cov[-1].pos - a + 1 AS g1 FROM p WHERE len(cov) > 0),
t AS (SELECT *, greatest(c1 - 10, 0) AS low, greatest(least(g1 + 10, length(ref) - 2), g1) AS high FROM q),
u AS (SELECT *, strpos(reverse(substr(ref, low + 1, c1 - low)), 'GC') AS hit, strpos(substr(ref, g1 + 2, high - g1), 'CG') AS stop FROM t),
v AS (SELECT *, CASE WHEN hit > 0 THEN c1 - hit ELSE low END AS lo, CASE WHEN stop > 0 THEN g1 + stop ELSE high END AS hi FROM u),
w AS (SELECT 'T' || substr(sample_id, 2) AS ctype, sample_id, dmr_label, cell_type AS dmr_ctype, read_count,
  regexp_replace(substr(ref, lo + 1, hi - lo + 1), '[^ACGT]', 'N', 'g') AS bases,
  array_to_string(list_transform(range(0, hi - lo - 1), lambda i: coalesce(translate(substr(filled, list_filter(cov, lambda c: c.pos = a + lo + i + 1)[1].idx - cpg_start + 1, 1), 'CT.', '102'), '2')), '') AS methyl_seq
  FROM v WHERE hi - lo - 1 > 0)
SELECT sample_id, {V.KMER_SQL.format('bases')} AS dna_seq, methyl_seq, dmr_label, ctype, dmr_ctype, CAST(sum(read_count) AS BIGINT) AS read_count
FROM w WHERE regexp_matches(methyl_seq, '[01]') GROUP BY sample_id, bases, methyl_seq, dmr_label, ctype, dmr_ctype
"""


def _build(spark, sf, **how):
    fragments = V.fragments(spark, sf).withColumn("ctype", F.concat(F.lit("T"), F.substring("sample_id", 2, 10)))
    return build_reads(fragments, V.markers(spark, sf), V.genome_cpgs(spark, sf), V.genome(spark, sf), V.CHUNK, **how)


@query("build_reads", BUILD_SQL)
def build_reads_query(spark, sf):
    return _build(spark, sf)


@query("build_reads_uncollapsed", f"SELECT sample_id, dmr_label, dna_seq, methyl_seq, read_count AS n FROM ({BUILD_SQL}) b")
def build_reads_uncollapsed(spark, sf):
    """Every read on its own; counted per distinct read it equals the collapsed table."""
    rows = _build(spark, sf, collapse=False)
    return rows.groupBy("sample_id", "dmr_label", "dna_seq", "methyl_seq", "ctype", "dmr_ctype").agg(
        F.sum("read_count").alias("n")
    ).drop("ctype", "dmr_ctype")


@query("built_on_target", f"""
SELECT sample_id, count(*) AS n_rows, CAST(sum(read_count) AS BIGINT) AS n_reads, count(DISTINCT dmr_ctype) AS n_region_types,
 round(avg(CASE WHEN ctype = dmr_ctype THEN 1.0 ELSE 0.0 END), 6) AS on_target_rows,
 round(CAST(sum(CASE WHEN ctype = dmr_ctype THEN read_count ELSE 0 END) AS DOUBLE) / sum(read_count), 6) AS on_target_reads
FROM ({BUILD_SQL}) b GROUP BY sample_id""")
def built_on_target(spark, sf):
    return profiles.on_target(_build(spark, sf))


FILE_ROWS = 1_000_000  # fragments that one task sorts by sample and writes


def _incoming(raw, path):
    """PAT files of every sample, written by tasks of bounded size; the number of tasks, three at least."""
    parts = max(3, -(-raw.count() // FILE_ROWS))
    dealt(raw.withColumnRenamed("sample_id", "sample"), parts).write.partitionBy("sample").csv(path, sep="\t")
    return parts


def _ingested(spark, sf, compact_every):
    src, out, state = (scratch_path(spark, n) for n in ("incoming", "reads", "state"))
    raw = V.raw_fragments(spark, sf)
    parts = _incoming(raw, src)
    samples = raw.select("sample_id").distinct().withColumn("ctype", F.concat(F.lit("T"), F.substring("sample_id", 2, 10)))
    marked = prepare_regions(V.markers(spark, sf), V.genome_cpgs(spark, sf), V.genome(spark, sf), V.CHUNK)
    # the folder names the sample here
    arriving = stream_fragments(spark, src, files_per_batch=-(-8 * parts // 3)).drop("sample_id").withColumnRenamed("sample", "sample_id")
    ingest_samples(arriving, stage(samples, "samples"), marked, out, state, compact_every=compact_every, buckets=5).awaitTermination()
    return read_ingested(spark, out)


@query("ingest_samples", BUILD_SQL)
def ingest_samples_query(spark, sf):
    """Many PAT files of every sample picked up by a stream, a few per batch; the table equals the batch build."""
    return _ingested(spark, sf, 0)


@query("ingest_compacted", BUILD_SQL)
def ingest_compacted(spark, sf):
    """The same with closed batches folded into buckets on the way."""
    return _ingested(spark, sf, 1)


def _first_call(batches):
    """A user extractor: the first called CpG of a pattern."""
    for pdf in batches:
        pdf = pdf.assign(first=pdf["pattern"].str.lstrip(".").str[:1])
        yield pdf[["sample_id", "cpg_start", "first"]]


@query("extract_reads", f"SELECT sample_id, cpg_start, left(ltrim(pattern, '.'), 1) AS first FROM ({V.FRAGMENTS_END_SQL}) f")
def extract_reads_query(spark, sf):
    rows = V.fragments(spark, sf).select("sample_id", "cpg_start", "pattern")
    return extract_reads(rows, _first_call, "sample_id string, cpg_start bigint, first string")


# --- aligned reads: three kinds of CIGAR, both strands, single and paired ------------------------

BISMARK_SQL = """
WITH s AS (SELECT o_orderkey AS qname, translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGCGACG') AS ref,
  translate(md5('x' || CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'zzzzzzzZZZZZZ..x') AS xm, o_orderkey % 3 AS kind,
  CASE o_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 65 WHEN 3 THEN 81 WHEN 4 THEN 129 ELSE 1024 END AS flag FROM orders),
c AS (SELECT *, CASE kind WHEN 0 THEN xm WHEN 1 THEN substr(xm, 5) ELSE substr(xm, 1, 10) || 'DD' || substr(xm, 11, 20) END AS calls,
  CASE WHEN flag & 1 = 1 THEN (flag & 16 <> 0) <> (flag & 64 <> 0) ELSE flag & 16 = 0 END AS top FROM s),
b AS (SELECT *, list_transform(range(1, 33), lambda i: CASE WHEN substr(ref, i, 2) <> 'CG' THEN substr(ref, i, 1)
   WHEN i > length(calls) THEN 'C' WHEN top THEN substr(calls, i, 1) WHEN i + 1 > length(calls) THEN 'C' ELSE substr(calls, i + 1, 1) END) AS raw,
  list_transform(range(1, 33), lambda i: substr(ref, i, 2) = 'CG' AND substr(calls, i, 2) LIKE '%D%') AS gap FROM c),
d AS (SELECT *, list_transform(range(1, 33), lambda i: CASE WHEN substr(ref, i, 2) = 'CG' AND (raw[i] IN ('.', 'D') OR (raw[i] = 'x' AND gap[i])) THEN 'C' ELSE raw[i] END) AS done FROM b)
SELECT qname, CASE WHEN flag = 1024 OR ref NOT LIKE '%CG%' OR list_contains(done, 'x') THEN NULL ELSE array_to_string(done, '') END AS bases,
 flag <> 1024 AND ref LIKE '%CG%' AND list_contains(done, 'x') AS failed FROM d
"""


@query("decode_bismark", BISMARK_SQL)
def decode_bismark(spark, sf):
    k, key = F.col("o_custkey") % 6, F.col("o_orderkey").cast("string")
    rows = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("qname"),
        F.translate(F.md5(key), "0123456789abcdef", "ACGTACGTACGCGACG").alias("ref"),
        F.translate(F.md5(F.concat(F.lit("x"), key)), "0123456789abcdef", "zzzzzzzZZZZZZ..x").alias("xm"),
        F.when(F.col("o_orderkey") % 3 == 0, "32M").when(F.col("o_orderkey") % 3 == 1, "4S28M").otherwise("10M2D20M2S").alias("cigar"),
        F.when(k == 0, 0).when(k == 1, 16).when(k == 2, 65).when(k == 3, 81).when(k == 4, 129).otherwise(1024).alias("flag"),
    )
    decoded = rows.select("qname", AL.decode_bismark("ref", "xm", "cigar", "flag").alias("d"))
    return decoded.select("qname", "d.bases", F.coalesce("d.failed", F.lit(False)).alias("failed"))


@query("decoded_kmers", """
SELECT o_orderkey, array_to_string(list_transform(range(1, 30), lambda i: substr(translate(b, 'zZx', 'CCC'), i, 3)), ' ') AS dna_seq,
 array_to_string(list_transform(range(1, 30), lambda i: CASE substr(b, i + 1, 1) WHEN 'z' THEN '0' WHEN 'Z' THEN '1' ELSE '2' END), '') AS methyl_seq
FROM (SELECT o_orderkey, translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTzZGTACxTACGT') AS b FROM orders) t""")
def decoded_kmers(spark, sf):
    bases = F.translate(F.md5(F.col("o_orderkey").cast("string")), "0123456789abcdef", "ACGTzZGTACxTACGT")
    rows = V.table(spark, sf, "orders").select("o_orderkey", bases.alias("bases"))
    dna, methyl = AL.decoded_kmers(F.col("bases"))
    return rows.select("o_orderkey", dna.alias("dna_seq"), methyl.alias("methyl_seq"))


@query("call_longread", """
SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN array_to_string(list_transform(range(0, 8), lambda i: CAST(i * 5 + 1 - (o_custkey % 2) AS VARCHAR) || ':' ||
 CASE WHEN CAST('0x' || substr(h, i * 2 + 1, 2) AS INT) + CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE CAST('0x' || substr(h, i * 2 + 17, 2) AS INT) END >= 178 THEN '1' ELSE '0' END), ' ') END AS calls
FROM (SELECT o_orderkey, o_custkey, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders) t""")
def call_longread(spark, sf):
    h = F.md5(F.col("o_orderkey").cast("string"))
    byte = lambda at: F.conv(F.substring(h, at, F.lit(2)), 16, 10).cast("int")
    spots = F.sequence(F.lit(0), F.lit(7))
    rows = V.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey",
        F.transform(spots, lambda i: i * 5 + 1).alias("positions"),
        F.transform(spots, lambda i: byte(i * 2 + 1)).alias("hydroxy"),
        F.when(F.col("o_custkey") % 3 != 0, F.transform(spots, lambda i: byte(i * 2 + 17))).alias("methyl"),
        F.when(F.col("o_custkey") % 4 == 0, "5H40M").otherwise("40M").alias("cigar"),
    )
    calls = AL.call_longread(F.col("positions"), F.col("hydroxy"), F.col("methyl"), F.col("cigar"), F.col("o_custkey") % 2 == 1)
    text = F.transform(calls, lambda c: F.concat(c["pos"].cast("string"), F.lit(":"), c["call"].cast("string")))
    return rows.select("o_orderkey", F.array_join(text, " ").alias("calls"))
