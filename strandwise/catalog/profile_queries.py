"""Counts, shares, de-duplication and combination of labelled reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.catalog import query, views as V
from strandwise.functions.naming import explode_composite
from strandwise.operators import combine, dedup as D, profiles as P

R = V.KEYED_SQL


@query("collapse_reads", f"SELECT dna_seq, methyl_seq, dmr_label, ctype, dmr_ctype, CAST(sum(read_count) AS BIGINT) AS read_count FROM ({R}) r GROUP BY ALL")
def collapse_reads(spark, sf):
    return D.collapse_reads(V.keyed_reads(spark, sf))


@query("drop_duplicate_rows", f"SELECT DISTINCT sample_id, dna_seq, methyl_seq, dmr_label, ctype, dmr_ctype, read_count FROM ({R}) r")
def drop_duplicate_rows(spark, sf):
    return D.drop_duplicate_rows(
        V.keyed_reads(spark, sf), ("sample_id", "dna_seq", "methyl_seq", "dmr_label", "ctype", "dmr_ctype", "read_count")
    )


@query("duplicate_report", f"""
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, CAST(sum(n) - count(*) AS BIGINT) AS n_removed,
 round(100.0 * (sum(n) - count(*)) / sum(n), 4) AS pct_removed
FROM (SELECT count(*) AS n FROM ({R}) r GROUP BY dna_seq, methyl_seq, dmr_label, ctype, dmr_ctype) g""")
def duplicate_report(spark, sf):
    return D.duplicate_report(V.keyed_reads(spark, sf), D.COLLAPSE_KEY)


@query("agreement", f"""
SELECT ctype, count(*) AS n_rows, count(*) FILTER (ctype = dmr_ctype) AS n_same,
 round(100.0 * count(*) FILTER (ctype = dmr_ctype) / count(*), 4) AS pct_same FROM ({R}) r GROUP BY ROLLUP (ctype)""")
def agreement(spark, sf):
    return P.agreement(V.reads(spark, sf))


@query("agreement_bands", f"""
SELECT CASE WHEN p >= 100 THEN 'perfect' WHEN p >= 80 THEN 'high' WHEN p >= 50 THEN 'moderate' ELSE 'low' END AS band,
 count(*) AS n_types, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(s) AS BIGINT) AS n_same
FROM (SELECT dmr_label, count(*) AS n, count(*) FILTER (ctype = dmr_ctype) AS s, 100.0 * count(*) FILTER (ctype = dmr_ctype) / count(*) AS p
      FROM (SELECT dmr_label, ctype, CASE WHEN dmr_label % 5 = 0 THEN ctype ELSE dmr_ctype END AS dmr_ctype FROM ({R}) r) q GROUP BY dmr_label) g
GROUP BY band""")
def agreement_bands(spark, sf):
    """Bands over regions, every fifth of which is labelled on target, so that several bands are filled."""
    rows = V.reads(spark, sf)
    own = F.concat(F.lit("L"), F.col("dmr_label").cast("string"))  # the region takes the place of the cell type
    same = (F.col("dmr_label") % 5 == 0) | (F.col("ctype") == F.col("dmr_ctype"))
    return P.agreement_bands(rows.select(own.alias("ctype"), F.when(same, own).otherwise("another").alias("dmr_ctype")))


@query("region_type_distribution", f"""
SELECT sample_id, dmr_ctype, n_rows, round(100.0 * n_rows / sum(n_rows) OVER (PARTITION BY sample_id), 4) AS pct
FROM (SELECT sample_id, dmr_ctype, count(*) AS n_rows FROM ({R}) r GROUP BY ALL) g""")
def region_type_distribution(spark, sf):
    return P.region_type_distribution(V.reads(spark, sf))


@query("label_by_region", f"""
SELECT dmr_label, ctype, count(*) AS n_rows,
 CASE grouping(dmr_label, ctype) WHEN 0 THEN 'region_type' WHEN 1 THEN 'region' WHEN 2 THEN 'type' ELSE 'all' END AS level
FROM ({R}) r GROUP BY GROUPING SETS ((dmr_label, ctype), (dmr_label), (ctype), ())""")
def label_by_region(spark, sf):
    return P.label_by_region(V.reads(spark, sf))


PROPORTIONS_SQL = f"""SELECT dmr_ctype, n_rows, round(100.0 * n_rows / sum(n_rows) OVER (), 4) AS pct
FROM (SELECT dmr_ctype, count(*) AS n_rows FROM ({R}) r GROUP BY dmr_ctype) g"""


@query("proportions", PROPORTIONS_SQL)
def proportions(spark, sf):
    return P.proportions(V.reads(spark, sf), "dmr_ctype")


@query("proportion_summary", f"""SELECT count(*) AS n_values, round(avg(pct), 4) AS mean_pct, round(median(pct), 4) AS median_pct,
 round(stddev_samp(pct), 4) AS std_pct, min(pct) AS min_pct, max(pct) AS max_pct FROM ({PROPORTIONS_SQL}) p""")
def proportion_summary(spark, sf):
    return P.proportion_summary(V.reads(spark, sf), "dmr_ctype")


LENGTHS_SQL = f"SELECT length(rtrim(methyl_seq, '2')) AS len FROM ({R}) r"


def _lengths(spark, sf):
    """Methylation strings without their uncalled tail, so that lengths differ."""
    return V.reads(spark, sf).select(F.rtrim(F.col("methyl_seq"), F.lit("2")).alias("methyl_seq"))


@query("length_profile", f"""SELECT count(*) AS n_rows, count(DISTINCT len) AS n_lengths, min(len) AS min_len, max(len) AS max_len,
 round(avg(len), 4) AS mean_len, round(median(len), 4) AS median_len, round(stddev_pop(len), 4) AS std_len FROM ({LENGTHS_SQL}) l""")
def length_profile(spark, sf):
    return P.length_profile(_lengths(spark, sf))


@query("length_counts", f"SELECT len AS length, count(*) AS n_rows, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM ({LENGTHS_SQL}) l GROUP BY len")
def length_counts(spark, sf):
    return P.length_counts(_lengths(spark, sf))


@query("length_histogram", f"""
SELECT CAST(least(floor((len - lo) * 50.0 / (hi - lo)), 49) AS INT) AS bin, count(*) AS n_rows
FROM ({LENGTHS_SQL}) l, (SELECT min(len) AS lo, max(len) AS hi FROM ({LENGTHS_SQL}) m) e GROUP BY bin""")
def length_histogram(spark, sf):
    return P.length_histogram(_lengths(spark, sf))


@query("top_lengths", f"SELECT len AS length, count(*) AS n_rows, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM ({LENGTHS_SQL}) l GROUP BY len ORDER BY n_rows DESC, length LIMIT 20")
def top_lengths(spark, sf):
    return P.top_lengths(_lengths(spark, sf))


@query("region_purity_counts", f"""
WITH p AS (SELECT dmr_label, count(DISTINCT ctype) AS k FROM ({R}) r GROUP BY dmr_label)
SELECT count(*) AS n_regions, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 6) AS share_one_type,
 round(avg(CASE WHEN k = (SELECT count(DISTINCT ctype) FROM ({R}) r) THEN 1.0 ELSE 0.0 END), 6) AS share_all_types FROM p""")
def region_purity_counts(spark, sf):
    return P.region_purity_counts(V.reads(spark, sf))


@query("on_target", f"""
SELECT sample_id, count(*) AS n_rows, CAST(sum(read_count) AS BIGINT) AS n_reads, count(DISTINCT dmr_ctype) AS n_region_types,
 round(avg(CASE WHEN ctype = dmr_ctype THEN 1.0 ELSE 0.0 END), 6) AS on_target_rows,
 round(CAST(sum(CASE WHEN ctype = dmr_ctype THEN read_count ELSE 0 END) AS DOUBLE) / sum(read_count), 6) AS on_target_reads
FROM ({R}) r GROUP BY sample_id""")
def on_target(spark, sf):
    return P.on_target(V.reads(spark, sf))


@query("top_region_types", f"""
SELECT ctype, dmr_ctype, n_rows, pct, place FROM (
 SELECT *, round(100.0 * n_rows / sum(n_rows) OVER (PARTITION BY ctype), 4) AS pct,
  row_number() OVER (PARTITION BY ctype ORDER BY n_rows DESC, dmr_ctype) AS place
 FROM (SELECT ctype, dmr_ctype, count(*) AS n_rows FROM ({R}) r GROUP BY ALL) g) h WHERE place <= 5""")
def top_region_types(spark, sf):
    return P.top_region_types(V.reads(spark, sf))


@query("region_cardinality", f"SELECT greatest(count(DISTINCT dmr_label), max(dmr_label) + 1) AS n_regions FROM ({R}) r")
def region_cardinality(spark, sf):
    return P.region_cardinality(V.reads(spark, sf))


@query("label_index", f"SELECT ctype, count(*) AS n_rows, row_number() OVER (ORDER BY ctype) - 1 AS label FROM ({R}) r GROUP BY ctype")
def label_index(spark, sf):
    """One index over two tables, here the reads of odd and of even regions."""
    rows = V.reads(spark, sf)
    odd = F.col("dmr_label") % 2 == 1
    return P.label_index(rows.where(odd), rows.where(~odd))


@query("profile_reads", f"""
SELECT count(*) AS n_rows, max(length(dna_seq) - 2) AS max_tokens, max(length(methyl_seq)) AS max_methyl,
 min(dmr_label) AS min_label, max(dmr_label) AS max_label, count(*) FILTER (length(dna_seq) - 2 <> length(methyl_seq)) AS n_mismatched
FROM ({R}) r""")
def profile_reads(spark, sf):
    from strandwise.functions.reads import kmers

    return P.profile_reads(V.reads(spark, sf).withColumn("dna_seq", kmers(F.col("dna_bases"))))


@query("sequence_weights", f"SELECT dna_seq, methyl_seq, CAST(sum(read_count) AS BIGINT) AS weight, count(*) AS n_rows FROM ({R}) r GROUP BY ALL")
def sequence_weights(spark, sf):
    return D.sequence_weights(V.keyed_reads(spark, sf))


@query("keep_first", f"""SELECT row_id, sample_id, dna_seq, methyl_seq, dmr_label, ctype, dmr_ctype, CASE WHEN read_count > 1 THEN 1 ELSE read_count END AS read_count
FROM (SELECT *, row_number() OVER (PARTITION BY dna_seq, methyl_seq ORDER BY row_id) AS k FROM ({R}) r) g WHERE k = 1""")
def keep_first(spark, sf):
    return D.keep_first(V.keyed_reads(spark, sf).drop("lane"))


TWINS_SQL = f"""SELECT *, count(*) OVER k AS n, min(ctype) OVER k AS lo, max(ctype) OVER k AS hi,
 row_number() OVER (PARTITION BY dna_seq, methyl_seq, dmr_label, dmr_ctype, read_count ORDER BY row_id) AS place
 FROM ({R}) r WINDOW k AS (PARTITION BY dna_seq, methyl_seq, dmr_label, dmr_ctype, read_count)"""


@query("dedup_cross_sample", f"SELECT row_id, sample_id, dna_seq, methyl_seq, dmr_label, ctype, dmr_ctype, read_count FROM ({TWINS_SQL}) t WHERE lo = hi AND place = 1")
def dedup_cross_sample(spark, sf):
    return D.dedup_cross_sample(V.keyed_reads(spark, sf).drop("lane"))


@query("dedup_shared_by_all", f"""
WITH r AS ({R}), k AS (
 SELECT dna_seq, methyl_seq, dmr_label, dmr_ctype, read_count, min(ctype) AS lo, max(ctype) AS hi, min(row_id) AS first_id
 FROM r GROUP BY ALL HAVING count(DISTINCT lane) = (SELECT count(DISTINCT lane) FROM r))
SELECT r.row_id, r.lane, r.dna_seq, r.methyl_seq, r.dmr_label, r.ctype, r.dmr_ctype, r.read_count FROM r LEFT JOIN k
 USING (dna_seq, methyl_seq, dmr_label, dmr_ctype, read_count) WHERE lo IS NULL OR (lo = hi AND row_id = first_id)""")
def dedup_shared_by_all(spark, sf):
    """The lane stands for the sample: some reads occur in every lane, none in every sample."""
    return D.dedup_shared_by_all(V.keyed_reads(spark, sf).drop("sample_id"), sample="lane")


@query("dedup_report", f"""
SELECT ctype, CASE WHEN lo <> hi THEN 'conflict' ELSE 'same_label' END AS reason, count(*) AS n_removed
FROM ({TWINS_SQL}) t WHERE lo <> hi OR place > 1 GROUP BY ALL""")
def dedup_report(spark, sf):
    return D.dedup_report(V.keyed_reads(spark, sf))


@query("expand_counts", f"""
SELECT row_id, ctype, 1 AS read_count FROM ({R}) r, range(1, greatest(r.read_count, 1) + 1) i""")
def expand_counts(spark, sf):
    return D.expand_counts(V.reads(spark, sf).select("row_id", "ctype", "read_count"))


@query("known_region_types", f"SELECT row_id, ctype, dmr_ctype FROM ({R}) r WHERE dmr_ctype IN (SELECT ctype FROM ({R}) s)")
def known_region_types(spark, sf):
    return combine.keep_known_region_types(V.reads(spark, sf).select("row_id", "ctype", "dmr_ctype"))


@query("focus_region_types", f"SELECT sample_id, dmr_ctype, count(*) AS n FROM ({R}) r WHERE sample_id = 's4-2' AND dmr_ctype IN (SELECT ctype FROM ({R}) s) GROUP BY ALL")
def focus_region_types(spark, sf):
    """Only the focus sample comes out, but every sample's type counts as known."""
    rows = V.reads(spark, sf).select("sample_id", "ctype", "dmr_ctype")
    return combine.keep_known_region_types(rows, focus="s4-2").groupBy("sample_id", "dmr_ctype").agg(F.count("*").alias("n"))


@query("combine_samples", f"""
SELECT row_id, sample_id, ctype, dmr_ctype, CASE WHEN dmr_label % 2 = 0 THEN read_count END AS read_count FROM ({R}) r WHERE dmr_ctype IN (SELECT ctype FROM ({R}) s)""")
def combine_samples(spark, sf):
    """Two inputs, one of them without a read count, combined and filtered to known types."""
    rows = V.reads(spark, sf).select("row_id", "sample_id", "dmr_label", "ctype", "dmr_ctype", "read_count")
    even = F.col("dmr_label") % 2 == 0
    both = combine.combine_samples([rows.where(even).drop("dmr_label"), rows.where(~even).drop("dmr_label", "read_count")])
    return combine.keep_known_region_types(both)


@query("explode_composite", f"""
SELECT member AS dmr_member, count(*) AS n_regions FROM (SELECT unnest(string_split(cell_type, ':')) AS member FROM ({V.REGIONS_SQL}) r) m GROUP BY member""")
def explode_composite_query(spark, sf):
    return explode_composite(V.regions(spark, sf), "cell_type").groupBy("dmr_member").agg(F.count("*").alias("n_regions"))
