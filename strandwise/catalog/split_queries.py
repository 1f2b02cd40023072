"""Splits, balancing and batches. Orders are md5 texts, so both engines draw the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.catalog import query, views as V
from strandwise.functions.pieces import split_long
from strandwise.functions.reads import kmers
from strandwise.operators import balancing as B, profiles, splitting as S
from strandwise.plans.make_split import make_split

R = V.KEYED_SQL


def _reads(spark, sf):
    return V.keyed_reads(spark, sf).drop("lane")


def _cut_sql(source: str, ratio: float, by: str | None, key: str = "row_id") -> str:
    """Rows in hash order of ``key``, the first floor(n * ratio) of each group on the train side."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, CASE WHEN row_number() OVER ({part} ORDER BY md5({key} || '|42')) <= floor(count(*) OVER ({part}) * {ratio})
 THEN 'train' ELSE 'test' END AS side FROM ({source}) src"""


@query("split_stratified", f"SELECT row_id, ctype, side FROM ({_cut_sql(R, 0.8, 'ctype')}) s")
def split_stratified(spark, sf):
    return S.split_stratified(_reads(spark, sf)).select("row_id", "ctype", "side")


@query("split_random", f"SELECT row_id, ctype, side FROM ({_cut_sql(R, 0.75, None)}) s")
def split_random(spark, sf):
    return S.split_random(_reads(spark, sf)).select("row_id", "ctype", "side")


SEQ_HASH = "md5(dna_seq || '|' || methyl_seq || '|42')"
SEQUENCE_SPLIT_SQL = f"""
WITH r AS ({R}),
g AS (SELECT ctype, {SEQ_HASH} AS h, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY ctype ORDER BY h) AS upto, sum(n) OVER (PARTITION BY ctype) AS total FROM g)
SELECT row_id, r.ctype, CASE WHEN 2 * upto - n <= 2 * floor(total * 0.75) THEN 'train' ELSE 'test' END AS side
FROM r JOIN c ON r.ctype = c.ctype AND {SEQ_HASH} = c.h
"""


@query("split_by_sequence", SEQUENCE_SPLIT_SQL)
def split_by_sequence(spark, sf):
    return S.split_by_sequence(_reads(spark, sf)).select("row_id", "ctype", "side")


ASSIGNMENT_SQL = f"""
WITH s AS (SELECT ctype, sample_id, count(*) AS n_rows, sum(read_count) AS weight FROM ({R}) r GROUP BY ALL),
a AS (SELECT *, count(*) OVER (PARTITION BY ctype) AS n, row_number() OVER sz AS k,
  row_number() OVER (PARTITION BY ctype ORDER BY sample_id) AS place, sum(weight) OVER (PARTITION BY ctype) AS total,
  sum(weight) OVER (PARTITION BY ctype ORDER BY n_rows DESC, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS train_w,
  max(weight) OVER (PARTITION BY ctype ORDER BY n_rows DESC, sample_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_w
  FROM s WINDOW sz AS (PARTITION BY ctype ORDER BY n_rows DESC, sample_id)),
b AS (SELECT *, floor(total * 0.75) AS target FROM a),
c AS (SELECT *, min(CASE WHEN k < n AND abs(train_w / total - 0.75) <= 0.05 AND train_w / total >= 0.7 THEN k END) OVER (PARTITION BY ctype) AS k_whole,
  min(CASE WHEN k < n AND target > train_w AND target - train_w < next_w AND target / total >= 0.7 THEN k END) OVER (PARTITION BY ctype) AS k_part FROM b),
d AS (SELECT *, CASE WHEN coalesce(k_whole, k_part) IS NOT NULL THEN k <= coalesce(k_whole, k_part) ELSE place <= greatest(floor(n * 0.75), 1) END AS in_train FROM c),
e AS (SELECT *, sum(CASE WHEN in_train THEN weight ELSE 0 END) OVER (PARTITION BY ctype) AS got,
  row_number() OVER (PARTITION BY ctype, in_train ORDER BY weight DESC, k) AS heavy FROM d),
f AS (SELECT *, least(target - got, weight) AS needed,
  NOT in_train AND CASE WHEN k_whole IS NOT NULL THEN FALSE WHEN k_part IS NOT NULL THEN heavy = 1 ELSE place = greatest(floor(n * 0.75), 1) + 1 END AS chosen FROM e)
SELECT ctype, sample_id, CASE WHEN n <= 3 OR (chosen AND needed > 0) THEN 'split' WHEN in_train THEN 'train' ELSE 'test' END AS plan,
 CASE WHEN n <= 3 THEN '*' ELSE sample_id END AS unit, CASE WHEN n <= 3 THEN 0.75 ELSE CAST(needed AS DOUBLE) / weight END AS share FROM f
"""


@query("sample_assignment", f"SELECT ctype, sample_id, plan, unit, round(share, 6) AS share FROM ({ASSIGNMENT_SQL}) a")
def sample_assignment(spark, sf):
    return S.sample_assignment(_reads(spark, sf)).drop("n_rows").withColumn("share", F.round("share", 6))


@query("split_by_sample", f"""
WITH r AS (SELECT r.*, a.plan, a.unit, a.share, {SEQ_HASH} AS h FROM ({R}) r JOIN ({ASSIGNMENT_SQL}) a ON r.ctype = a.ctype AND r.sample_id = a.sample_id),
g AS (SELECT ctype, unit, h, count(*) AS n, max(share) AS share FROM r WHERE plan = 'split' GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY ctype, unit ORDER BY h) AS upto, sum(n) OVER (PARTITION BY ctype, unit) AS total FROM g)
SELECT r.row_id, r.ctype, r.sample_id, CASE WHEN plan = 'split' THEN CASE WHEN 2 * upto - n <= 2 * floor(total * c.share) THEN 'train' ELSE 'test' END ELSE plan END AS side
FROM r LEFT JOIN c ON r.plan = 'split' AND r.ctype = c.ctype AND r.unit = c.unit AND r.h = c.h""")
def split_by_sample(spark, sf):
    return S.split_by_sample(_reads(spark, sf)).select("row_id", "ctype", "sample_id", "side")


FIRST_SQL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dna_seq, methyl_seq ORDER BY row_id) AS k FROM ({R}) r) g WHERE k = 1"


@query("dedup_then_split", f"SELECT row_id, ctype, 1 AS read_count, side FROM ({_cut_sql(FIRST_SQL, 0.75, None)}) s")
def dedup_then_split(spark, sf):
    return S.dedup_then_split(_reads(spark, sf)).select("row_id", "ctype", "read_count", "side")


KEY = "dna_seq, methyl_seq, dmr_label, dmr_ctype, read_count"
CROSS_SQL = f"""SELECT * FROM (SELECT *, min(ctype) OVER (PARTITION BY {KEY}) AS lo, max(ctype) OVER (PARTITION BY {KEY}) AS hi,
 row_number() OVER (PARTITION BY {KEY} ORDER BY row_id) AS place FROM ({R}) r) t WHERE lo = hi AND place = 1"""


@query("dedup_cross_sample_split", f"SELECT row_id, ctype, side FROM ({_cut_sql(CROSS_SQL, 0.75, None)}) s")
def dedup_cross_sample_split(spark, sf):
    return S.dedup_cross_sample_split(_reads(spark, sf)).select("row_id", "ctype", "side")


SHARED_SQL = f"""
SELECT r.* FROM ({R}) r LEFT JOIN (
 SELECT {KEY}, min(ctype) AS lo, max(ctype) AS hi, min(row_id) AS first_id FROM ({R}) k GROUP BY ALL HAVING count(DISTINCT lane) = (SELECT count(DISTINCT lane) FROM ({R}) a)) k
USING ({KEY}) WHERE lo IS NULL OR (lo = hi AND row_id = first_id)"""


@query("dedup_shared_split", f"SELECT row_id, ctype, side FROM ({_cut_sql(SHARED_SQL, 0.75, None)}) s")
def dedup_shared_split(spark, sf):
    return S.dedup_shared_split(V.keyed_reads(spark, sf), sample="lane").select("row_id", "ctype", "side")


@query("split_manual", f"""
SELECT row_id, sample_id, 1 AS read_count, CASE WHEN sample_id LIKE '%-0' THEN 'train' ELSE 'test' END AS side
FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, dna_seq, methyl_seq ORDER BY row_id) AS k FROM ({R}) r) g WHERE k = 1""")
def split_manual(spark, sf):
    rows = _reads(spark, sf)
    sides = rows.select("sample_id").distinct().withColumn(
        "side", F.when(F.col("sample_id").endswith("-0"), F.lit("train")).otherwise(F.lit("test"))
    )
    return S.split_manual(rows, sides).select("row_id", "sample_id", "read_count", "side")


@query("split_train_valid_test", f"""
WITH n AS (SELECT sample_id || ':' || CAST(dmr_label AS VARCHAR) AS name, min(ctype) AS label FROM ({R}) r GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(name || '|42')) AS k, count(*) OVER (PARTITION BY label) AS n FROM n)
SELECT r.row_id, o.name, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'valid' ELSE 'test' END AS side
FROM ({R}) r JOIN o ON r.sample_id || ':' || CAST(r.dmr_label AS VARCHAR) = o.name""")
def split_train_valid_test(spark, sf):
    named = _reads(spark, sf).withColumn("name", F.concat_ws(":", "sample_id", F.col("dmr_label").cast("string")))
    return S.split_train_valid_test(named, (0.6, 0.2, 0.2), "name").select("row_id", "name", "side")


@query("split_report", f"""
WITH s AS ({_cut_sql(R, 0.8, 'ctype')}),
c AS (SELECT ctype, count(*) FILTER (side = 'train') AS a, count(*) FILTER (side = 'test') AS b FROM s GROUP BY ctype)
SELECT ctype, a AS n_train, b AS n_test, round(100.0 * (a / sum(a) OVER ()), 4) AS pct_train, round(100.0 * (b / sum(b) OVER ()), 4) AS pct_test,
 round(100.0 * abs(a / sum(a) OVER () - b / sum(b) OVER ()), 4) AS pct_diff FROM c""")
def split_report(spark, sf):
    return profiles.split_report(S.split_stratified(_reads(spark, sf)))


@query("sequence_groups", f"SELECT sample_id, seq_key, CAST(weight AS BIGINT) AS weight, n, group_type FROM (SELECT sample_id, md5(dna_seq || '|' || methyl_seq) AS seq_key, sum(read_count) AS weight, count(*) AS n, arg_min(dmr_ctype, row_id) AS group_type FROM ({R}) r GROUP BY sample_id, md5(dna_seq || '|' || methyl_seq)) g")
def sequence_groups(spark, sf):
    return B.sequence_groups(_reads(spark, sf)).drop("first_at", "first_type")


# The chain over types is a recursion over at most nine types per sample.
def _balance_sql(source: str, out: str) -> str:
    return f"""
WITH RECURSIVE r AS MATERIALIZED ({source}),
g AS MATERIALIZED (SELECT sample_id, md5(dna_seq || '|' || methyl_seq) AS seq_key, CAST(sum(read_count) AS BIGINT) AS weight, arg_min(dmr_ctype, row_id) AS group_type
  FROM r GROUP BY sample_id, md5(dna_seq || '|' || methyl_seq)),
own AS (SELECT sample_id, arg_min(ctype, row_id) AS own_type FROM r GROUP BY sample_id),
t AS (SELECT g.*, own_type, CAST(sum(CASE WHEN group_type = own_type THEN weight ELSE 0 END) OVER (PARTITION BY g.sample_id) AS BIGINT) AS positive
  FROM g JOIN own ON g.sample_id = own.sample_id),
ranked AS MATERIALIZED (SELECT *, CAST(sum(weight) OVER (PARTITION BY sample_id, group_type ORDER BY weight, md5(seq_key || '|42')) AS BIGINT) AS upto
  FROM t WHERE group_type <> own_type AND positive > 0),
types AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY group_type) AS i, count(*) OVER (PARTITION BY sample_id) AS n,
  CAST(sum(have) OVER (PARTITION BY sample_id) AS BIGINT) AS total
  FROM (SELECT sample_id, group_type, max(positive) AS positive, CAST(sum(weight) AS BIGINT) AS have FROM ranked GROUP BY ALL) x),
chain AS (
  SELECT sample_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS allocated, CAST(0 AS BIGINT) AS want, '' AS group_type FROM (SELECT DISTINCT sample_id FROM types) z
  UNION ALL
  SELECT y.sample_id, y.i, y.allocated + coalesce((SELECT max(upto) FROM ranked q WHERE q.sample_id = y.sample_id AND q.group_type = y.group_type AND q.upto <= y.want), 0), y.want, y.group_type
  FROM (SELECT c.sample_id, t.i, t.group_type, c.allocated,
     CAST(greatest(0, least(CASE WHEN t.i = t.n THEN t.positive - c.allocated ELSE round_even(CAST(t.have AS DOUBLE) / t.total * t.positive, 0) END, t.have, t.positive - c.allocated)) AS BIGINT) AS want
     FROM chain c JOIN types t ON t.sample_id = c.sample_id AND t.i = c.i + 1) y),
kept AS (SELECT sample_id, seq_key FROM t WHERE group_type = own_type OR positive = 0
  UNION ALL SELECT q.sample_id, q.seq_key FROM ranked q JOIN chain c ON c.i > 0 AND q.sample_id = c.sample_id AND q.group_type = c.group_type AND q.upto <= c.want)
SELECT {out} FROM r
WHERE EXISTS (SELECT 1 FROM kept k WHERE k.sample_id = r.sample_id AND k.seq_key = md5(r.dna_seq || '|' || r.methyl_seq))
"""


BALANCE_SQL = _balance_sql(R, "row_id, sample_id, ctype, dmr_ctype")


@query("balance_on_target", BALANCE_SQL)
def balance_on_target(spark, sf):
    return B.balance_on_target(_reads(spark, sf)).select("row_id", "sample_id", "ctype", "dmr_ctype")


PREFIX_SQL = f"""
WITH g AS (SELECT sample_id, md5(dna_seq || '|' || methyl_seq) AS seq_key, sum(read_count) AS weight, arg_min(dmr_ctype, row_id) AS group_type
  FROM ({R}) r GROUP BY sample_id, md5(dna_seq || '|' || methyl_seq)),
o AS (SELECT *, sum(weight) OVER (PARTITION BY sample_id, group_type ORDER BY weight, md5(seq_key || '|42')) AS upto,
  sum(weight) OVER (PARTITION BY sample_id, group_type) AS total FROM g)
SELECT sample_id, group_type, seq_key, CAST(weight AS BIGINT) AS weight FROM o WHERE upto <= floor(total / 3)
"""


@query("off_target_prefix", PREFIX_SQL)
def off_target_prefix(spark, sf):
    """Lightest third of every (sample, region type)."""
    groups = B.sequence_groups(_reads(spark, sf))
    hist = groups.groupBy("sample_id", "group_type", "weight").agg(F.count("*").alias("groups"))
    targets = B.stage(B.edges_of(hist, lambda total: F.floor(total / 3)), "targets")
    return B.off_target_prefix(groups, targets).select("sample_id", "group_type", "seq_key", "weight")


def _batch_sql(batch: int, drop_last: bool) -> str:
    batches = "floor(small / q)" if drop_last else "ceil(small / q)"
    return f"""
WITH r AS (SELECT row_id, ctype, row_number() OVER (PARTITION BY ctype ORDER BY md5(row_id || '|42')) AS k, count(*) OVER (PARTITION BY ctype) AS n FROM ({R}) r),
p AS (SELECT greatest({batch} // count(*), 1) AS q, min(n) AS small FROM (SELECT DISTINCT ctype, n FROM r) c),
u AS (SELECT q, CAST({batches} * q AS BIGINT) AS used FROM p)
SELECT row_id, ctype, (k - 1 + j * n) // q AS batch, (k - 1 + j * n) % q AS slot
FROM (SELECT r.*, u.*, unnest(range(0, CAST(floor((used - k) / n) AS BIGINT) + 1)) AS j FROM r, u WHERE k <= used) w
"""


@query("balanced_batches", _batch_sql(100, False))
def balanced_batches(spark, sf):
    return B.balanced_batches(_reads(spark, sf).select("row_id", "ctype"), 100)


@query("balanced_batches_full", _batch_sql(1000, True))
def balanced_batches_full(spark, sf):
    return B.balanced_batches(_reads(spark, sf).select("row_id", "ctype"), 1000, drop_last=True)


def _spelled(df):
    return df.withColumn("dna_seq", kmers(F.col("dna_seq")))


@query("split_long", f"""
WITH r AS (SELECT row_id, {V.KMER_SQL.format('dna_seq')} AS dna_seq, methyl_seq FROM ({R}) r),
h AS (SELECT *, 0 AS lo, 30 AS n FROM r),
a AS (SELECT row_id, dna_seq, methyl_seq, unnest([0, 15]) AS lo, 15 AS n FROM h),
b AS (SELECT row_id, dna_seq, methyl_seq, lo + unnest([0, 7]) AS lo, unnest([7, 8]) AS n FROM a)
SELECT row_id, CAST(lo / 7.4 AS INT) AS piece, substr(methyl_seq, lo + 1, n) AS methyl_seq, substr(dna_seq, lo * 4 + 1, n * 4 - 1) AS dna_seq FROM b""")
def split_long_query(spark, sf):
    """Thirty tokens halved twice to pieces of 7 and 8."""
    return split_long(_spelled(_reads(spark, sf).select("row_id", "dna_seq", "methyl_seq")), 8)


@query("make_split", f"""
WITH r AS (SELECT *, {SEQ_HASH.replace('dna_seq', V.KMER_SQL.format('dna_seq'))} AS h FROM ({R}) r WHERE dmr_ctype IN (SELECT ctype FROM ({R}) s)),
g AS (SELECT ctype, h, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY ctype ORDER BY h) AS upto, sum(n) OVER (PARTITION BY ctype) AS total FROM g)
SELECT r.ctype, dmr_label, dmr_ctype, CASE WHEN 2 * upto - c.n <= 2 * floor(total * 0.75) THEN 'train' ELSE 'test' END AS side, count(*) AS n_reads,
 CAST(sum(read_count) AS BIGINT) AS weight FROM r JOIN c ON r.ctype = c.ctype AND r.h = c.h GROUP BY ALL""")
def make_split_query(spark, sf):
    sides = make_split(_spelled(_reads(spark, sf)), "sequence")
    return sides.groupBy("ctype", "dmr_label", "dmr_ctype", "side").agg(
        F.count("*").alias("n_reads"), F.sum("read_count").alias("weight")
    )


# reads of 30 tokens, some cut to 20, which are too short
TOKENS_SQL = f"""SELECT row_id, sample_id, ctype, dmr_label, dmr_ctype, read_count, sample_id || ':' || CAST(dmr_label AS VARCHAR) AS name, substr(methyl_seq, 1, n) AS methyl_seq,
 array_to_string(list_transform(range(1, n + 1), lambda i: substr(dna_seq, i, 3)), ' ') AS dna_seq FROM (SELECT *, CASE WHEN row_id < '4' THEN 20 ELSE 30 END AS n FROM ({R}) r) t WHERE dmr_ctype IN (SELECT ctype FROM ({R}) s)"""


def _tokens(spark, sf):
    n = F.when(F.col("row_id") < "4", 20).otherwise(30)
    rows = _reads(spark, sf).withColumns({
        "dna_seq": F.substring("dna_seq", F.lit(1), n + 2), "methyl_seq": F.substring("methyl_seq", F.lit(1), n),
        "name": F.concat_ws(":", "sample_id", F.col("dmr_label").cast("string")),
    })
    return _spelled(rows)


def _pieces_sql(sides: str, cuts: dict[int, int], columns: str) -> str:
    """Pieces (first token, tokens) of the reads of 30 tokens in ``sides``."""
    starts, sizes = list(cuts), list(cuts.values())
    return f"""SELECT {columns}, side, i - 1 AS piece, substr(methyl_seq, {starts}[i] + 1, {sizes}[i]) AS methyl_seq, substr(dna_seq, {starts}[i] * 4 + 1, {sizes}[i] * 4 - 1) AS dna_seq
FROM (SELECT *, CAST(unnest(range(1, {len(cuts) + 1})) AS INT) AS i FROM ({sides}) s WHERE length(methyl_seq) >= 25) p"""


QUARTERS, HALVES = {0: 7, 7: 8, 15: 7, 22: 8}, {0: 15, 15: 15}


@query("make_split_expanded", f"""
WITH r AS MATERIALIZED ({TOKENS_SQL}), g AS (SELECT ctype, {SEQ_HASH} AS h, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY ctype ORDER BY h) AS upto, sum(n) OVER (PARTITION BY ctype) AS total FROM g),
s AS (SELECT r.*, CASE WHEN 2 * upto - n <= 2 * floor(total * 0.75) THEN 'train' ELSE 'test' END AS side FROM r JOIN c ON r.ctype = c.ctype AND {SEQ_HASH} = c.h),
e AS (SELECT * EXCLUDE (copy) FROM (SELECT *, unnest(range(read_count)) AS copy FROM s) x)
{_pieces_sql('SELECT * FROM e', QUARTERS, 'row_id, ctype, dmr_label')}""")
def make_split_expanded(spark, sf):
    """Sequences on one side, every read as often as it was counted, four pieces of each."""
    return make_split(_tokens(spark, sf), "sequence", longest=8, expand=True, extra=("row_id",))


@query("make_split_balanced", f"""
WITH b AS ({_balance_sql(TOKENS_SQL, '*')}), s AS ({_cut_sql('SELECT * FROM b', 0.8, 'ctype')})
{_pieces_sql('SELECT * FROM s', HALVES, 'row_id, ctype, dmr_label, dmr_ctype, read_count')}""")
def make_split_balanced(spark, sf):
    """Balanced samples, a stratified cut, the extra columns kept, two pieces of each read."""
    return make_split(_tokens(spark, sf), "stratified", balance=True, longest=15, extra=("row_id", "dmr_ctype", "read_count"))


@query("make_split_three_way", f"""
WITH r AS MATERIALIZED ({TOKENS_SQL}), n AS (SELECT name, min(ctype) AS label FROM r GROUP BY name),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(name || '|42')) AS k, count(*) OVER (PARTITION BY label) AS n FROM n),
s AS (SELECT r.*, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'valid' ELSE 'test' END AS side FROM r JOIN o ON o.name = r.name)
{_pieces_sql('SELECT * FROM s', HALVES, 'row_id, ctype, dmr_label, name')}""")
def make_split_three_way(spark, sf):
    """Names on one of three sides."""
    return make_split(_tokens(spark, sf), "three_way", longest=20, extra=("row_id", "name"), ratios=(0.6, 0.2, 0.2), by="name")
