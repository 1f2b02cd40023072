"""Leakage audits over a train / test pair cut from the reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.catalog import query, views as V
from strandwise.operators import audits as A, combine
from strandwise.plans.reports import audit_split

R = V.KEYED_SQL
# the sides: a plain hash of the row, so that copies of a read land on both
SIDES_SQL = f"WITH r AS ({R}), train AS (SELECT * FROM r WHERE row_id < 'c'), test AS (SELECT * FROM r WHERE row_id >= 'c')"


def _sides(spark, sf):
    rows = V.keyed_reads(spark, sf)
    is_train = F.col("row_id") < "c"
    return rows.where(is_train), rows.where(~is_train)


EXACT_SQL = SIDES_SQL + """
SELECT count(*) AS n_test, count(*) FILTER (hit) AS n_twins, round(CAST(count(*) FILTER (hit) AS DOUBLE) / count(*), 6) AS share_twins
FROM (SELECT (dna_seq, methyl_seq, dmr_label) IN (SELECT (dna_seq, methyl_seq, dmr_label) FROM train) AS hit FROM test) t"""


@query("exact_twins", EXACT_SQL)
def exact_twins(spark, sf):
    train, test = _sides(spark, sf)
    return A.exact_twins(test, train)


CONFLICT_SQL = SIDES_SQL + """,
l AS (SELECT dna_seq, methyl_seq, list(DISTINCT ctype) AS types FROM train GROUP BY ALL),
t AS (SELECT test.ctype, l.types FROM test LEFT JOIN l ON test.dna_seq = l.dna_seq AND test.methyl_seq = l.methyl_seq)
SELECT count(*) AS n_test, count(types) AS n_twins, count(*) FILTER (len(list_filter(types, lambda x: x <> ctype)) > 0) AS n_conflicts,
 round(CAST(count(types) AS DOUBLE) / count(*), 6) AS share_twins,
 round(CAST(count(*) FILTER (len(list_filter(types, lambda x: x <> ctype)) > 0) AS DOUBLE) / count(*), 6) AS share_conflicts FROM t"""


@query("conflicting_twins", CONFLICT_SQL)
def conflicting_twins(spark, sf):
    train, test = _sides(spark, sf)
    return A.conflicting_twins(test, train)


LOOKUP_SQL = SIDES_SQL + """,
m AS (SELECT dmr_label, ctype AS predicted FROM (SELECT dmr_label, ctype, row_number() OVER (PARTITION BY dmr_label ORDER BY count(*) DESC, ctype) AS k
  FROM train GROUP BY dmr_label, ctype) x WHERE k = 1)
SELECT count(*) AS n_test, count(predicted) AS n_covered, round(CAST(count(*) FILTER (predicted = ctype) AS DOUBLE) / count(predicted), 6) AS accuracy,
 round(CAST(count(predicted) AS DOUBLE) / count(*), 6) AS coverage FROM test LEFT JOIN m ON test.dmr_label = m.dmr_label"""


@query("region_lookup_baseline", LOOKUP_SQL)
def region_lookup_baseline(spark, sf):
    return A.region_lookup_baseline(*_sides(spark, sf))


@query("leak_check", SIDES_SQL + """,
k AS (SELECT dna_seq, methyl_seq, max(CASE WHEN row_id < 'c' THEN 1 ELSE 0 END) AS a, max(CASE WHEN row_id >= 'c' THEN 1 ELSE 0 END) AS b FROM r GROUP BY ALL)
SELECT CAST(sum(a) AS BIGINT) AS train_keys, CAST(sum(b) AS BIGINT) AS test_keys, CAST(sum(a * b) AS BIGINT) AS shared_keys FROM k""")
def leak_check(spark, sf):
    return combine.leak_check(*_sides(spark, sf))


@query("document_twins", """
WITH d AS (SELECT text, lang, source FROM documents), tr AS (SELECT * FROM d WHERE source < 'src5'), te AS (SELECT * FROM d WHERE source >= 'src5')
SELECT count(*) AS n_test, count(*) FILTER (text IN (SELECT text FROM tr)) AS n_twins,
 round(CAST(count(*) FILTER (text IN (SELECT text FROM tr)) AS DOUBLE) / count(*), 6) AS share_twins FROM te""")
def document_twins(spark, sf):
    """Exact copies between two halves of the documents, whole texts compared."""
    docs = V.table(spark, sf, "documents").select("text", "source")
    first = F.col("source") < "src5"
    return A.exact_twins(docs.where(~first), docs.where(first), ("text",))


def _metric(sql: str, *names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({c} AS DOUBLE) AS value FROM ({sql}) q" for m, c in (n.split("=") for n in names))


@query("audit_split", " UNION ALL ".join([
    _metric(EXACT_SQL, "share_exact_twins=share_twins"),
    _metric(CONFLICT_SQL, "share_twins=share_twins", "share_conflicts=share_conflicts"),
    _metric(LOOKUP_SQL, "accuracy=accuracy", "coverage=coverage"),
    _metric(f"""WITH p AS (SELECT dmr_label, count(DISTINCT ctype) AS k FROM ({R}) r GROUP BY dmr_label)
     SELECT count(*) AS a, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 6) AS b,
      round(avg(CASE WHEN k = (SELECT count(DISTINCT ctype) FROM ({R}) r) THEN 1.0 ELSE 0.0 END), 6) AS c FROM p""",
            "n_regions=a", "share_one_type=b", "share_all_types=c"),
    _metric(SIDES_SQL + """ SELECT round(avg(CASE WHEN ctype = dmr_ctype THEN 1.0 ELSE 0.0 END), 6) AS a,
     round(CAST(sum(CASE WHEN ctype = dmr_ctype THEN read_count ELSE 0 END) AS DOUBLE) / sum(read_count), 6) AS b FROM train""",
            "on_target_rows=a", "on_target_reads=b"),
]))
def audit_split_query(spark, sf):
    return audit_split(*_sides(spark, sf))
