"""First rows found by numbers: plans without sorted aggregation, ties in the order, and frequent keys."""

import pytest
from pyspark.sql import functions as F

from strandwise.functions.keys import content_digest
from strandwise.operators import balancing, dedup
from strandwise.operators.firsts import lead_numbers, numbered, order_number, rows_at, tied_keys
from strandwise.session import stage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made(spark, rows):
    return spark.createDataFrame(rows, "k string, o string, v int")


def firsts(df, key=("k",), order="o"):
    numbers = numbered(df, key, order)
    return rows_at(df, numbers, stage(lead_numbers(numbers, key), "lead"), list(key), order)


ROWS = [
    ("a", "row-0000000002", 1), ("a", "row-0000000001", 2), ("a", "row-0000000003", 3),  # alike in their first letters
    ("b", "x", 4), ("b", "x", 4), ("b", "x", 4),  # alike in all
    ("c", "x", 5), ("c", "xx", 6), ("c", "x\x00", 7),
    ("d", None, 8), ("d", "z", 9), ("e", None, 10),
    (None, "y", 11), (None, "z", 12), ("f", "", 13),
]


def test_ties_are_resolved_by_the_rest_of_the_order(spark):
    got = {r.k: (r.o, r.v) for r in firsts(made(spark, ROWS).where("k IS NOT NULL")).collect()}
    assert got == {"a": ("row-0000000001", 2), "b": ("x", 4), "c": ("x", 5), "d": ("z", 9), "e": (None, 10), "f": ("", 13)}


def test_equal_orders_give_one_row(spark):
    rows = [("a", "same", i) for i in range(50)]
    first = firsts(made(spark, rows)).collect()
    assert len(first) == 1 and first == firsts(made(spark, rows[::-1])).collect()


def test_order_numbers_keep_the_order(spark):
    texts = ["", "a", "aa", "ab", "abcdefg", "abcdefh", "b", "é", "日"]
    df = made(spark, [(t, t, i) for i, t in enumerate(texts)])
    got = [r[0] for r in df.orderBy("v").select(order_number(df, "o")).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)
    times = spark.sql("SELECT date'1960-01-01' AS d, timestamp'1960-01-01' AS t, -5 AS n, 1.5D AS x")
    assert all(v < 0 for v in times.select(*[order_number(times, c) for c in "dtn"]).first())
    with pytest.raises(TypeError):
        order_number(times, "x")


@pytest.mark.parametrize("ids", ["id", "concat('a-long-common-start-', lpad(id, 9, '0'))"])
def test_against_windows(spark, ids):
    """One key holds a third of the rows."""
    rows = spark.range(3000).selectExpr(
        f"{ids} AS row_id", "'s' || id % 3 AS sample_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'd' || id % 200 END AS dna_seq",
        "'m' AS methyl_seq", "1 AS dmr_label", "'T' || cast(id / 1500 AS int) AS ctype", "'T0' AS dmr_ctype", "CAST(2 AS int) AS read_count",
    )
    rows = stage(rows, "rows")
    rows.createOrReplaceTempView("first_rows")
    first = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY row_id) AS k, min(ctype) OVER (PARTITION BY {by}) AS lo, max(ctype) OVER (PARTITION BY {by}) AS hi, size(collect_set(sample_id) OVER (PARTITION BY {by})) AS n FROM first_rows)"
    want = lambda by, where: sorted(r[0] for r in spark.sql(first.format(by=by) + f" WHERE {where}").select("row_id").collect())
    got = lambda df: sorted(r[0] for r in df.select("row_id").collect())
    assert got(dedup.keep_first(rows)) == want("dna_seq", "k = 1")
    assert got(dedup.keep_first(rows, per_sample=True)) == want("dna_seq, sample_id", "k = 1")
    assert got(dedup.dedup_cross_sample(rows)) == want("dna_seq", "k = 1 AND lo = hi")
    assert got(dedup.dedup_shared_by_all(rows)) == want("dna_seq", "n < 3 OR (k = 1 AND lo = hi)")
    groups = balancing.sequence_groups(rows).collect()
    assert len(groups) == rows.select("sample_id", "dna_seq").distinct().count() and sum(g.n for g in groups) == 3000


def test_reads_are_hashed_not_sorted(spark):
    """No aggregation over reads carries rows or texts, and what is fetched is spread by key and number."""
    rows = spark.createDataFrame([("r", "s", "d", "m", 1, "T", "T", 1)], "row_id string, sample_id string, dna_seq string, methyl_seq string, dmr_label int, ctype string, dmr_ctype string, read_count int")
    keyed = rows.withColumn("_key", content_digest("dna_seq"))
    numbers = numbered(keyed, ["_key"], "row_id")
    twins = numbered(dedup._with_twin_key(rows), ["_key"], "row_id", dedup._type_number(), "sample_id")
    for df in (
        lead_numbers(numbers, ["_key"]),
        lead_numbers(twins, ["_key"], *dedup._type_range()),
        dedup.shared_keys(twins, ["_key"], [], "sample_id"),
        tied_keys(numbers, stage(lead_numbers(numbers, ["_key"]), "lead"), ["_key"]),
        dedup.keep_first(rows), dedup.dedup_cross_sample(rows), dedup.dedup_shared_by_all(rows), balancing.sequence_groups(rows),
    ):
        assert "SortAggregate" not in plan(df) and "ObjectHashAggregate" not in plan(df)
    assert twins.columns == ["_key", "_number", "_type", "sample_id"]  # numbers and digests only
    assert "Exchange hashpartitioning" not in plan(dedup.dedup_shared_by_all(rows))  # few shared keys: no read moves


def test_ties_show_in_the_rows_found_and_numbers_are_not_joined(spark, monkeypatch):
    """Without ties the order numbers are read once; with ties what was carried stays with the row."""
    from strandwise.operators import firsts as module

    looked = []
    monkeypatch.setattr(module, "tied_keys", lambda *a, f=tied_keys: looked.append(a) or f(*a))
    for rows, ties in (([("a", "2", 1), ("a", "1", 2), (None, "1", 3)], 0), (ROWS[:-3], 1)):
        df = made(spark, rows)
        numbers = module.order_numbers(df, ["k"], "o")
        lead = stage(lead_numbers(numbers, ["k"], F.count("*").alias("n")), "lead")
        got = {r.k: (r.o, r.n) for r in rows_at(df, numbers, lead, ["k"], "o", ["n"]).collect()}
        assert got["a"] == (("1", 2), ("row-0000000001", 3))[ties] and None not in got and len(looked) == ties


def test_keys_are_not_computed_again_to_test_for_null(spark):
    rows = spark.range(1).selectExpr("id AS row_id", "'a' AS dna_seq", "'m' AS methyl_seq", "1 AS read_count").withColumn("_key", content_digest("dna_seq"))
    assert not rows.schema["_key"].nullable
