"""Column functions over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.catalog import query, views as V
from strandwise.catalog.interval_queries import IMPUTE_SQL
from strandwise.functions import coords, naming as N, reads as X, tokens as T
from strandwise.operators import selection

R = V.KEYED_SQL
F_SQL = V.FRAGMENTS_SQL


@query("kmers", f"SELECT o_orderkey, {V.KMER_SQL.format('b')} AS kmers, {V.KMER_SQL.format('b[1:length(b) - 1]')} AS kmers_short FROM (SELECT o_orderkey, regexp_replace(upper(translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTacgtACGTACGN')), '[^ACGT]', 'N', 'g') AS b FROM orders) t")
def kmers(spark, sf):
    seq = F.translate(F.md5(F.col("o_orderkey").cast("string")), "0123456789abcdef", "ACGTacgtACGTACGN")
    return V.table(spark, sf, "orders").select("o_orderkey", X.kmers(seq).alias("kmers"), X.kmers(seq, drop_last=True).alias("kmers_short"))


@query("impute_missing", f"SELECT pattern, {IMPUTE_SQL} AS filled, count(*) AS n FROM ({F_SQL}) f GROUP BY pattern")
def impute_missing(spark, sf):
    counts = V.raw_fragments(spark, sf).groupBy("pattern").agg(F.count("*").alias("n"))
    return counts.select("pattern", X.impute_missing(F.col("pattern")).alias("filled"), "n")


@query("n_cpg", f"SELECT row_id, length(regexp_replace(methyl_seq, '[^01]', '', 'g')) AS n_cpg FROM ({R}) r")
def n_cpg(spark, sf):
    return V.reads(spark, sf).select("row_id", X.n_cpg(F.col("methyl_seq")).alias("n_cpg"))


@query("drop_uninformative", f"SELECT row_id, methyl_seq FROM (SELECT row_id, CASE WHEN dmr_label % 4 = 0 THEN translate(methyl_seq, '01', '22') ELSE methyl_seq END AS methyl_seq FROM ({R}) r) s WHERE regexp_matches(methyl_seq, '[01]')")
def drop_uninformative(spark, sf):
    blank = F.translate("methyl_seq", "01", "22")
    rows = V.reads(spark, sf).select("row_id", F.when(F.col("dmr_label") % 4 == 0, blank).otherwise(F.col("methyl_seq")).alias("methyl_seq"))
    return selection.drop_uninformative(rows)


@query("filter_length", f"SELECT row_id, methyl_seq FROM (SELECT row_id, rtrim(methyl_seq, '2') AS methyl_seq FROM ({R}) r) s WHERE length(methyl_seq) >= 25")
def filter_length(spark, sf):
    rows = V.reads(spark, sf).select("row_id", F.rtrim(F.col("methyl_seq"), F.lit("2")).alias("methyl_seq"))
    return selection.filter_length(rows)


@query("normalize_chromosome", """
SELECT name, CASE WHEN regexp_extract(name, '^(chr[0-9XYM]+)', 1) <> '' THEN regexp_extract(name, '^(chr[0-9XYM]+)', 1) ELSE name END AS chr, n
FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'chr' || CAST(p_size AS VARCHAR) || '_KI' || CAST(p_partkey AS VARCHAR) || '_alt'
  WHEN 1 THEN 'chrX' WHEN 2 THEN 'chrY' WHEN 3 THEN 'scaffold_' || CAST(p_size AS VARCHAR) ELSE 'chr' || CAST(p_size AS VARCHAR) END AS name, count(*) AS n FROM part GROUP BY name) t
WHERE NOT regexp_matches(name, '^chr[XY]$')""")
def normalize_chromosome(spark, sf):
    size = F.col("p_size").cast("string")
    kind = F.col("p_size") % 5
    name = (
        F.when(kind == 0, F.concat(F.lit("chr"), size, F.lit("_KI"), F.col("p_partkey").cast("string"), F.lit("_alt")))
        .when(kind == 1, "chrX").when(kind == 2, "chrY").when(kind == 3, F.concat(F.lit("scaffold_"), size))
        .otherwise(F.concat(F.lit("chr"), size))
    )
    counts = V.table(spark, sf, "part").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return counts.select("name", coords.normalize_chromosome(F.col("name")).alias("chr"), "n").where(coords.is_autosome(F.col("chr")))


@query("drop_sex_chromosomes", """
SELECT chr, n, regexp_matches(chr, 'chr[0-9]') AS numbered FROM (
 SELECT CASE p_size % 4 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chrY' WHEN 2 THEN 'chrM' ELSE 'chr' || CAST(p_size AS VARCHAR) || '_alt' END AS chr, count(*) AS n FROM part GROUP BY 1) t
WHERE chr NOT IN ('chrX', 'chrY')""")
def drop_sex_chromosomes(spark, sf):
    kind = F.col("p_size") % 4
    name = F.when(kind == 0, "chrX").when(kind == 1, "chrY").when(kind == 2, "chrM").otherwise(
        F.concat(F.lit("chr"), F.col("p_size").cast("string"), F.lit("_alt"))
    )
    counts = V.table(spark, sf, "part").groupBy(name.alias("chr")).agg(F.count("*").alias("n")).where(coords.is_autosome(F.col("chr")))
    return counts.withColumn("numbered", coords.is_autosome(F.col("chr"), numbered_only=True))


@query("clean_reads", """
SELECT dna_seq, methyl_seq, ctype, CAST(dmr_label AS INT) AS dmr_label FROM (
 SELECT p_name AS dna_seq, CASE WHEN p_partkey % 7 = 0 THEN 'xx' ELSE CAST(p_size AS VARCHAR) END AS methyl_seq,
  CASE WHEN p_partkey % 5 = 0 THEN ' ' WHEN p_partkey % 5 = 1 THEN NULL ELSE p_brand END AS ctype,
  CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE CAST(p_partkey AS VARCHAR) END AS dmr_label FROM part) t
WHERE trim(dna_seq) <> '' AND trim(ctype) <> '' AND regexp_matches(methyl_seq, '[012]') AND TRY_CAST(dmr_label AS INT) IS NOT NULL""")
def clean_reads(spark, sf):
    k = F.col("p_partkey")
    return selection.clean_reads(V.table(spark, sf, "part").select(
        F.col("p_name").alias("dna_seq"),
        F.when(k % 7 == 0, "xx").otherwise(F.col("p_size").cast("string")).alias("methyl_seq"),
        F.when(k % 5 == 0, " ").when(k % 5 == 1, F.lit(None)).otherwise(F.col("p_brand")).alias("ctype"),
        F.when(k % 11 == 0, "n/a").otherwise(k.cast("string")).alias("dmr_label"),
    ))


@query("project_training", f"SELECT dna_seq, methyl_seq, ctype, dmr_label, read_count, dmr_ctype FROM ({R}) r")
def project_training(spark, sf):
    return selection.project_training(V.keyed_reads(spark, sf).withColumnRenamed("dmr_label", "dmr_Label"), keep_extra=True)


@query("clamp_label", f"SELECT least(dmr_label, 24) AS dmr_label, count(*) AS n FROM ({R}) r GROUP BY 1")
def clamp_label(spark, sf):
    return V.reads(spark, sf).groupBy(selection.clamp_label(F.col("dmr_label"), 25).alias("dmr_label")).agg(F.count("*").alias("n"))


@query("first_rows", f"SELECT row_id, ctype FROM ({R}) r ORDER BY row_id LIMIT 100")
def first_rows(spark, sf):
    return selection.first_rows(V.reads(spark, sf).select("row_id", "ctype"), 100, "row_id")


VOCAB_SQL = "list_position(list_sort(list_transform(range(0, 64), lambda i: substr('ACGT', CAST(i // 16 AS INT) + 1, 1) || substr('ACGT', CAST(i // 4 AS INT) % 4 + 1, 1) || substr('ACGT', CAST(i AS INT) % 4 + 1, 1))), {0})"
# 32 bases with N: 30 tokens, of which the first 20 (or 40 slots with padding) are kept
ENCODE_SQL = """
SELECT chr, chunk_id, array_to_string(list_concat([3], list_concat(ids[1:{keep}], list_concat([2], list_transform(range({keep}, {max} - 1), lambda i: 0)))), ' ') AS ids,
 array_to_string(list_concat([2], list_concat(st[1:{keep}], list_transform(range({keep}, {max}), lambda i: 2))), ' ') AS states
FROM (SELECT chr, chunk_id, list_transform(range(1, 31), lambda i: CAST(coalesce({vocab} + 4, 1) AS INT)) AS ids,
  list_transform(range(1, 31), lambda i: CAST(translate(substr(seq, i + 1, 1), 'ACGTN', '01222') AS INT)) AS st FROM ({genome}) g) t"""


def _encode_sql(max_len: int, keep: int) -> str:
    position = VOCAB_SQL.format("substr(seq, i, 3)").replace("lambda i: substr('ACGT'", "lambda z: substr('ACGT'")
    position = position.replace("i // 16", "z // 16").replace("i // 4", "z // 4").replace("CAST(i AS INT) % 4", "CAST(z AS INT) % 4")
    return ENCODE_SQL.format(max=max_len, keep=keep, genome=V.GENOME_SQL, vocab=f"nullif({position}, 0)")


def _encoded(spark, sf, max_len):
    g = V.genome(spark, sf)
    states = F.translate(F.substring("seq", 2, 30), "ACGTN", "01222")
    ids, marks = T.encode(X.kmers(F.col("seq")), states, max_len)
    return g.select("chr", "chunk_id", ids.alias("ids"), marks.alias("states"))


@query("encode_tokens", _encode_sql(20, 19))
def encode_tokens(spark, sf):
    return _encoded(spark, sf, 20).select(
        "chr", "chunk_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
        F.array_join(F.col("states").cast("array<string>"), " ").alias("states"),
    )


@query("encode_tokens_padded", _encode_sql(40, 30))
def encode_tokens_padded(spark, sf):
    return _encoded(spark, sf, 40).select(
        "chr", "chunk_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
        F.array_join(F.col("states").cast("array<string>"), " ").alias("states"),
    )


@query("decode_tokens", """
SELECT o_orderkey, translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS bases FROM orders""")
def decode_tokens(spark, sf):
    """Encoding and decoding gives the bases back when every token is known."""
    seq = F.translate(F.md5(F.col("o_orderkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    ids, _ = T.encode(X.kmers(seq), F.repeat(F.lit("2"), F.lit(30)), 40)
    return V.table(spark, sf, "orders").select("o_orderkey", T.decode(ids).alias("bases"))


DRAW_SQL = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) / 4294967296.0"


@query("crop_random", f"""
SELECT o_orderkey, array_to_string(list_transform(range(1, n + 1), lambda i: 5 + 16 * (strpos('ACGT', substr(b, i, 1)) - 1) + 4 * (strpos('ACGT', substr(b, i + 1, 1)) - 1) + strpos('ACGT', substr(b, i + 2, 1)) - 1), ' ') AS ids
FROM (SELECT o_orderkey, translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b, CASE WHEN {DRAW_SQL.format("o_orderkey || '|crop|42'")} < 0.5
 THEN least(30, 5 + CAST(floor({DRAW_SQL.format("o_orderkey || '|length|42'")} * 36) AS INT)) ELSE 30 END AS n FROM orders) o""")
def crop_random(spark, sf):
    seq = F.translate(F.md5(F.col("o_orderkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    ids = T.token_ids(X.kmers(seq))
    cropped = T.crop_random(ids, F.col("o_orderkey"), 40)
    return V.table(spark, sf, "orders").select("o_orderkey", F.array_join(cropped.cast("array<string>"), " ").alias("ids"))


MASK_SQL = """
WITH o AS (SELECT o_orderkey, translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b, unnest(range(0, 40)) AS p FROM orders),
d AS (SELECT *, md5(o_orderkey || '|' || p || '|42') AS h, CASE WHEN p < 30 THEN 5 + 16 * (strpos('ACGT', substr(b, p + 1, 1)) - 1) + 4 * (strpos('ACGT', substr(b, p + 2, 1)) - 1) + strpos('ACGT', substr(b, p + 3, 1)) - 1 ELSE 0 END AS id FROM o),
c AS (SELECT *, p < 30 AND CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967296.0 < 0.15 AS centre, CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0 AS kind,
 CAST(floor(CAST('0x' || substr(h, 17, 8) AS BIGINT) / 4294967296.0 * 69) AS INT) AS word FROM d),
m AS (SELECT *, centre OR (p < 30 AND (coalesce(lag(centre) OVER w, FALSE) OR coalesce(lead(centre) OVER w, FALSE))) AS masked FROM c WINDOW w AS (PARTITION BY o_orderkey ORDER BY p))
SELECT o_orderkey, '3 ' || string_agg(CAST(CASE WHEN p = 29 THEN 2 WHEN NOT masked OR kind >= 0.9 THEN id WHEN kind < 0.8 THEN 4 ELSE word END AS VARCHAR), ' ' ORDER BY p) AS inputs,
 '-100 ' || string_agg(CAST(CASE WHEN masked THEN id ELSE -100 END AS VARCHAR), ' ' ORDER BY p) AS labels, count(*) FILTER (centre) AS n_centres FROM m GROUP BY o_orderkey
"""


@query("mask_tokens", MASK_SQL)
def mask_tokens(spark, sf):
    """Thirty known tokens padded to forty; the last token shows the end marker."""
    seq = F.translate(F.md5(F.col("o_orderkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    ids = F.concat(T.token_ids(X.kmers(seq)), F.array_repeat(F.lit(T.PAD), 10))
    rows = V.table(spark, sf, "orders").select("o_orderkey", T.mask_tokens(ids, F.col("o_orderkey")).alias("m"))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ")
    return rows.select(
        "o_orderkey", text(F.col("m.inputs")).alias("inputs"), text(F.col("m.labels")).alias("labels"),
        F.size(F.filter("m.centres", lambda x: x)).cast("long").alias("n_centres"),
    )


@query("canonical", "SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS canonical FROM documents")
def canonical(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", N.canonical(F.col("text")).alias("canonical"))


SAMPLE_NAME_SQL = """
WITH b AS (SELECT page_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS base FROM (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '-', '_') WHEN 1 THEN '/data/Skeletal-Muscle_' || CAST(page_id AS VARCHAR) || '_250.csv'
   WHEN 2 THEN 'Blood-T_' || CAST(page_id AS VARCHAR) || '.csv' ELSE '/x/Bone_marrow-Eryth_R' || CAST(page_id AS VARCHAR) || '.csv' END AS path FROM pages) p),
s AS (SELECT page_id, CASE WHEN len(string_split(base, '_')) > 1 AND base LIKE '%\\_250' ESCAPE '\\' THEN string_split(base, '_')[1:-2] ELSE string_split(base, '_') END AS parts FROM b),
t AS (SELECT page_id, parts[-1] AS ident, array_to_string(parts[1:-2], '_') AS ctype, len(parts) AS n FROM s)
SELECT page_id, CASE WHEN n >= 2 THEN CASE ctype WHEN 'Adipocytes' THEN 'GSM5652176_Adipocytes-Z000000' WHEN 'Skeletal-Muscle' THEN 'GSM5652205_Skeletal-Muscle-Z00000'
 WHEN 'Blood-T' THEN 'GSM5652277_Blood-T-CD3-Z000000' ELSE 'GSM5652XXX_' || replace(ctype, '_', '-') || '-Z000000' END || ident || '.hg38.pat.gz' END AS sample_id FROM t
"""


@query("sample_id_from_name", SAMPLE_NAME_SQL)
def sample_id_from_name(spark, sf):
    k, text = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = (
        F.when(k == 0, F.replace("url", F.lit("-"), F.lit("_")))
        .when(k == 1, F.concat(F.lit("/data/Skeletal-Muscle_"), text, F.lit("_250.csv")))
        .when(k == 2, F.concat(F.lit("Blood-T_"), text, F.lit(".csv")))
        .otherwise(F.concat(F.lit("/x/Bone_marrow-Eryth_R"), text, F.lit(".csv")))
    )
    return V.table(spark, sf, "pages").select("page_id", N.sample_id_from_name(path).alias("sample_id"))


def _family_values() -> str:
    return ", ".join(f"('{c}', '{f}')" for f, members in N.FAMILIES.items() for c in members)


CTYPES = sorted({c for members in N.FAMILIES.values() for c in members})


@query("family", f"""
WITH scheme(ctype, family) AS (VALUES {_family_values()})
SELECT s.family, s.ctype, count(*) AS n FROM (SELECT ({CTYPES!r})[p_partkey % {len(CTYPES)} + 1] AS ctype FROM part) p JOIN scheme s ON s.ctype = p.ctype GROUP BY ALL""")
def family(spark, sf):
    """Types that belong to two families count in both."""
    names = F.array(*[F.lit(c) for c in CTYPES])
    rows = V.table(spark, sf, "part").select(F.get(names, (F.col("p_partkey") % len(CTYPES)).cast("int")).alias("ctype"))
    return N.assign_family(rows, N.family_table(spark)).groupBy("family", "ctype").agg(F.count("*").alias("n"))
