"""Range joins: fragments, CpG index and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.catalog import query, views as V
from strandwise.functions.reads import impute_missing
from strandwise.operators import combine, dedup, intervals as I, profiles, selection

J3_SQL = f"""
SELECT f.sample_id, f.chr, f.cpg_start, f.cpg_end, f.pattern, f.read_count, r.dmr_label, r.cell_type
FROM ({V.FRAGMENTS_END_SQL}) f JOIN ({V.REGIONS_SQL}) r
 ON f.chr = r.chr AND f.cpg_start <= r.cpg_end AND r.cpg_start <= f.cpg_end
"""


def _overlap(spark, sf):
    return I.overlap_fragments(V.fragments(spark, sf), V.regions(spark, sf)).select(
        "sample_id", "chr", "cpg_start", "cpg_end", "pattern", "read_count", "dmr_label", "cell_type"
    )


@query("fragment_overlap", J3_SQL)
def fragment_overlap(spark, sf):
    return _overlap(spark, sf)


ON_TARGET_FLAGSHIP_SQL = f"""
WITH c AS (
 SELECT sample_id, pattern, dmr_label, cell_type, sum(read_count) AS n FROM ({J3_SQL}) j GROUP BY ALL)
SELECT sample_id, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_reads, count(DISTINCT cell_type) AS n_region_types,
 round(avg(CASE WHEN cell_type = 'T' || substr(sample_id, 2) THEN 1.0 ELSE 0.0 END), 6) AS on_target_rows,
 round(CAST(sum(CASE WHEN cell_type = 'T' || substr(sample_id, 2) THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS on_target_reads
FROM (SELECT sample_id, {{impute}} AS filled, dmr_label, cell_type, sum(n) AS n FROM c GROUP BY ALL) d GROUP BY sample_id
"""
IMPUTE_SQL = (
    "CASE WHEN regexp_matches(pattern, '[CT]') THEN "
    "repeat(left(array_to_string(list_transform(regexp_extract_all(pattern, '[CT]\\.*'), lambda r: repeat(left(r, 1), length(r))), ''), 1), "
    "length(regexp_extract(pattern, '^(\\.*)', 1))) || "
    "array_to_string(list_transform(regexp_extract_all(pattern, '[CT]\\.*'), lambda r: repeat(left(r, 1), length(r))), '') "
    "ELSE pattern END"
)


@query("sample_on_target", ON_TARGET_FLAGSHIP_SQL.format(impute=IMPUTE_SQL))
def sample_on_target(spark, sf):
    """Collapsed reads and on-target share of every sample."""
    pairs = _overlap(spark, sf).select(
        "sample_id", impute_missing(F.col("pattern")).alias("dna_seq"), "dmr_label",
        F.concat(F.lit("T"), F.substring("sample_id", 2, 10)).alias("ctype"),
        F.col("cell_type").alias("dmr_ctype"), "read_count",
    )
    collapsed = dedup.collapse_reads(pairs, ("sample_id", "dna_seq", "dmr_label", "ctype", "dmr_ctype"))
    return profiles.on_target(collapsed)


RANGE_SQL = f"""
SELECT m.dmr_label, m.chr, m."start", m."end", min(c.cpg_idx) AS cpg_start, max(c.cpg_idx) AS cpg_end,
 coalesce(max(c.cpg_idx) - min(c.cpg_idx) + 1, 0) AS n_cpg
FROM ({V.MARKERS_SQL}) m LEFT JOIN ({V.CPG_SQL}) c ON c.chr = m.chr AND c.pos BETWEEN m."start" AND m."end"
GROUP BY ALL
"""


@query("cpg_range", RANGE_SQL)
def cpg_range(spark, sf):
    ranged = I.attach_cpg_range(V.markers(spark, sf), V.cpg_index(spark, sf))
    return ranged.select(
        "dmr_label", "chr", "start", "end", "cpg_start", "cpg_end",
        I.cpg_count(F.col("cpg_start"), F.col("cpg_end")).alias("n_cpg"),
    )


@query("require_cpgs", f"SELECT chr, count(*) AS n_regions, CAST(sum(n_cpg) AS BIGINT) AS n_cpg FROM ({RANGE_SQL}) r WHERE cpg_start IS NOT NULL GROUP BY chr")
def require_cpgs(spark, sf):
    kept = I.require_cpgs(I.attach_cpg_range(V.markers(spark, sf), V.cpg_index(spark, sf)))
    return kept.groupBy("chr").agg(
        F.count("*").alias("n_regions"), F.sum(I.cpg_count(F.col("cpg_start"), F.col("cpg_end"))).alias("n_cpg")
    )


OVERLAP_REGIONS_SQL = f"""
WITH m AS ({V.MARKERS_SQL})
SELECT a.dmr_label, a.chr, a.cell_type, string_agg(DISTINCT b.cell_type, ',' ORDER BY b.cell_type) AS target_types
FROM m a JOIN m b ON a.chr = b.chr AND a."start" <= b."end" AND b."start" <= a."end" AND b.cell_type IN ('T1', 'T1:T2', 'T5')
GROUP BY ALL
"""


@query("overlap_regions", OVERLAP_REGIONS_SQL)
def overlap_regions(spark, sf):
    hit = I.overlap_regions(V.markers(spark, sf), F.col("cell_type").isin("T1", "T1:T2", "T5"))
    return hit.select("dmr_label", "chr", "cell_type", F.array_join("target_types", ",").alias("target_types"))


CONTAIN_SQL = f"""
SELECT a.qname, a.chr, a.pos, a.pos_end, m.dmr_label, m.cell_type
FROM (SELECT l_orderkey * 10 + l_linenumber AS qname, 'chr' || CAST(l_partkey % 5 + 1 AS VARCHAR) AS chr, l_orderkey * 6 AS pos,
      l_orderkey * 6 + CAST(l_quantity AS BIGINT) AS pos_end FROM lineitem) a
JOIN ({V.MARKERS_SQL}) m ON a.chr = m.chr AND a.pos >= m."start" AND a.pos_end <= m."end"
"""


@query("contain_join", CONTAIN_SQL)
def contain_join(spark, sf):
    aligned = V.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qname"),
        F.concat(F.lit("chr"), (F.col("l_partkey") % 5 + 1).cast("string")).alias("chr"),
        (F.col("l_orderkey") * 6).alias("pos"),
        (F.col("l_orderkey") * 6 + F.col("l_quantity").cast("bigint")).alias("pos_end"),
    )
    return I.contain_join(aligned, V.markers(spark, sf)).select("qname", "chr", "pos", "pos_end", "dmr_label", "cell_type")


REGION_CPGS_SQL = f"""
WITH m AS ({V.MARKERS_SQL}), c AS ({V.CPG_SQL})
SELECT m.dmr_label, m.chr, c.pos, c.cpg_idx, row_number() OVER (PARTITION BY m.dmr_label ORDER BY c.pos) - 1 AS ordinal
FROM m JOIN c ON c.chr = m.chr AND c.pos BETWEEN m."start" AND m."end"
"""


@query("region_cpgs", REGION_CPGS_SQL)
def region_cpgs(spark, sf):
    cpg = V.cpg_index(spark, sf)
    return I.region_cpgs(I.attach_cpg_range(V.markers(spark, sf), cpg), cpg)


SELECT_SQL = f"""
SELECT s.sample_id, r.dmr_label, r.cell_type FROM ({V.REGIONS_SQL}) r
JOIN (SELECT DISTINCT 's' || CAST(l_suppkey % 8 AS VARCHAR) AS sample_id, 'T' || CAST(l_suppkey % 8 AS VARCHAR) AS cell_type FROM lineitem) s
 ON s.cell_type = r.cell_type
"""


@query("select_regions", SELECT_SQL)
def select_regions(spark, sf):
    samples = V.table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 8).cast("string")).alias("sample_id"),
        F.concat(F.lit("T"), (F.col("l_suppkey") % 8).cast("string")).alias("cell_type"),
    ).distinct()
    return I.select_regions(V.regions(spark, sf), samples, "target").select("sample_id", "dmr_label", "cell_type")


FILTER_SQL = f"""
SELECT 'exact' AS rule, cell_type, count(*) AS n FROM ({V.REGIONS_SQL}) r WHERE cell_type IN ('T1', 'T3') GROUP BY cell_type
UNION ALL
SELECT 'canonical', cell_type, count(*) FROM ({V.REGIONS_SQL}) r
WHERE lower(regexp_replace(cell_type, '[^A-Za-z0-9]', '', 'g')) LIKE '%t2%' OR lower(regexp_replace(cell_type, '[^A-Za-z0-9]', '', 'g')) LIKE '%t6%' GROUP BY cell_type
"""


@query("filter_regions", FILTER_SQL)
def filter_regions(spark, sf):
    r = V.regions(spark, sf)
    exact = selection.filter_regions(r, ["T1", "T3"]).groupBy("cell_type").agg(F.count("*").alias("n"))
    canon = selection.filter_regions(r, ["t-2", "T.6"], "canonical").groupBy("cell_type").agg(F.count("*").alias("n"))
    return exact.select(F.lit("exact").alias("rule"), "*").unionByName(canon.select(F.lit("canonical").alias("rule"), "*"))


TOP_REGIONS_SQL = f"""
SELECT ctype, dmr_label, stat FROM (
 SELECT *, row_number() OVER (PARTITION BY ctype ORDER BY abs(stat) DESC, dmr_label) AS k FROM (
  SELECT 'T' || CAST(p_size % 8 AS VARCHAR) AS ctype, p_partkey AS dmr_label, p_retailprice - 1000 AS stat FROM part) a) b
WHERE k <= 20
"""


@query("top_regions", TOP_REGIONS_SQL)
def top_regions(spark, sf):
    r = V.table(spark, sf, "part").select(
        F.concat(F.lit("T"), (F.col("p_size") % 8).cast("string")).alias("ctype"),
        F.col("p_partkey").alias("dmr_label"), (F.col("p_retailprice") - 1000).alias("stat"),
    )
    return selection.top_regions(r, 20, "stat")


@query("assign_region_ids", """
SELECT p_partkey AS dmr_label, p_retailprice - 1000 AS stat, row_number() OVER (ORDER BY abs(p_retailprice - 1000) DESC, p_partkey) - 1 AS dmr_id FROM part""")
def assign_region_ids(spark, sf):
    r = V.table(spark, sf, "part").select(F.col("p_partkey").alias("dmr_label"), (F.col("p_retailprice") - 1000).alias("stat"))
    return selection.assign_region_ids(r, "stat", "dmr_label")


SKIP_SQL = f"""
WITH w AS (SELECT DISTINCT sample_id, dmr_label FROM ({J3_SQL}) j)
SELECT sample_id, dmr_label FROM w WHERE NOT EXISTS (
 SELECT 1 FROM lineitem l WHERE 's' || CAST(l.l_suppkey % 8 AS VARCHAR) = w.sample_id AND l.l_partkey = w.dmr_label AND l.l_returnflag = 'R')
"""


@query("skip_processed", SKIP_SQL)
def skip_processed(spark, sf):
    work = _overlap(spark, sf).select("sample_id", "dmr_label").distinct()
    done = V.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 8).cast("string")).alias("sample_id"), F.col("l_partkey").alias("dmr_label")
    )
    return combine.skip_processed(work, done)


TYPES_SQL = """
WITH s AS (SELECT c_custkey AS sample_id, 'T' || CAST(c_nationkey % 12 AS VARCHAR) AS cell_type FROM customer),
 r AS (SELECT DISTINCT 'T' || CAST(p_size % 15 + 2 AS VARCHAR) AS cell_type FROM part)
"""


def _type_tables(spark, sf):
    samples = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("sample_id"), F.concat(F.lit("T"), (F.col("c_nationkey") % 12).cast("string")).alias("cell_type")
    )
    regions = V.table(spark, sf, "part").select(F.concat(F.lit("T"), (F.col("p_size") % 15 + 2).cast("string")).alias("cell_type"))
    return samples, regions


@query("types_to_process", TYPES_SQL + "SELECT sample_id, cell_type FROM s WHERE cell_type IN (SELECT cell_type FROM r)")
def types_to_process(spark, sf):
    return combine.types_to_process(*_type_tables(spark, sf)).select("sample_id", "cell_type")


@query("missing_types", TYPES_SQL + """
SELECT cell_type, 'not_configured' AS problem FROM r WHERE cell_type NOT IN (SELECT cell_type FROM s)
UNION ALL SELECT DISTINCT cell_type, 'no_regions' FROM s WHERE cell_type NOT IN (SELECT cell_type FROM r)""")
def missing_types(spark, sf):
    return combine.missing_types(*_type_tables(spark, sf))
