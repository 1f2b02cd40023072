"""The k-d tree against a plain recursion that sorts whole nodes, and its laws on skewed tables."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwise.llm import sharding as sh


def letters(name):
    return -1 if name is None else int.from_bytes(name.encode()[:6].ljust(6, b"\0"), "big")


def plain(rows, shards):
    """{id: shard} of rows (id, source, lang, text) with ids of their own."""
    made = []
    for i, source, lang, text in rows:
        size = len((text or "").encode()) + 1
        made.append((i, size, (letters(source), letters(lang), size), int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16)))
    extent = [max(m[2][a] for m in made) - min(m[2][a] for m in made) for a in range(3)]
    out = {}

    def cut(node, first, k):
        if not node or k == 1:
            out.update((m[0], first) for m in node)
            return
        width = [(max(m[2][a] for m in node) - min(m[2][a] for m in node)) / extent[a] if extent[a] else 0.0 for a in range(3)]
        axis = width.index(max(width))
        node = sorted(node, key=lambda m: (m[2][axis], m[3]))
        twice, run, left = max(1, 2 * sum(m[1] for m in node) * (k // 2) // k), 0, []
        for m in node:
            run += m[1]
            if 2 * run - m[1] <= twice:
                left.append(m)
        cut(left, first, k // 2)
        cut(node[len(left):], first + k // 2, k - k // 2)

    cut(made, 0, shards)
    return out


def made_rows(n=400):
    rows = [(i, f"src{i * i % 7}" if i % 3 else "hot", [None, "de", "fr"][i % 4 % 3], "x" * (i * 37 % 301) + "ü" * (i % 5)) for i in range(n)]
    return rows + [(n + i, "hot", "de", "the same text") for i in range(n // 2)]


@pytest.mark.parametrize("shards,sort_rows,bins", [(8, 1 << 14, 4096), (8, 3, 64), (1, 1, 2), (3, 50, 16)])
def test_against_plain_tree(spark, monkeypatch, shards, sort_rows, bins):
    monkeypatch.setattr(sh, "SORT_ROWS", sort_rows)
    monkeypatch.setattr(sh, "BINS", bins)
    rows = made_rows()
    got = sh.shard(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), shards, keep=["doc_id"])
    assert {r.doc_id: r.shard.shard for r in got.collect()} == plain(rows, shards)


def laws(got, shards, largest):
    """Near equal bytes and gapless slots."""
    rows = got.select("shard.*").collect()
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert set(sums) <= set(range(shards))
    mean = sum(sums.values()) / shards
    assert all(abs(sums[k] - mean) <= 4 * largest for k in range(shards))
    for k in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("sort_rows", [40, 1 << 14])
def test_one_key_may_hold_most_rows(spark, monkeypatch, sort_rows):
    monkeypatch.setattr(sh, "SORT_ROWS", sort_rows)
    monkeypatch.setattr(sh, "BINS", 64)
    docs = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("one").alias("source"),
        F.lit(None).cast("string").alias("lang"), F.lit("equal").alias("text"),
    )
    laws(sh.shard(docs, 8), 8, 6)


def test_nodes_met_by_node(spark, monkeypatch):
    monkeypatch.setattr(sh, "BROADCAST_NODES", 0)
    rows = made_rows(80)
    got = sh.shard(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), 6, keep=["doc_id"])
    assert {r.doc_id: r.shard.shard for r in got.collect()} == plain(rows, 6)


def test_target_bytes_and_own_dimensions(spark):
    docs = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 50).alias("year"), F.lit(10).alias("bytes"))
    got = sh.shard(docs, target_bytes=700, size=F.col("bytes"), dimensions=[F.col("year")], doc_id="key")
    sums = {r.shard: r["sum(size)"] for r in got.select("year", "shard.*").groupBy("shard").sum("size").collect()}
    assert len(sums) == 15 and max(sums.values()) <= 710
    spread = got.groupBy("shard.shard").agg((F.max("year") - F.min("year")).alias("w")).agg(F.max("w")).first()[0]
    assert spread <= 4  # leaves are narrow on the one dimension
    with pytest.raises(ValueError):
        sh.shard(docs, 3, 700)


def test_written_shards_come_back(spark, tmp_path):
    rows = made_rows(60)
    got = sh.shard(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), 4)
    sh.write_shards(got, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.text, r.shard) for r in back.collect()) == sorted((r.doc_id, r.text, r.shard.shard) for r in got.collect())


def test_hostile_rows(spark, hostile, empty):
    docs = hostile.withColumns({"lang": F.lit("de"), "c": F.lit(1), "c0": F.lit(2), "r": F.lit(3), "h": F.lit(4), "d": F.lit(5), "node": F.lit(6), "k": F.lit(7), "shard": F.lit("old")})
    got = sh.shard(docs, 8)
    assert got.columns == docs.columns
    names = [c for c in docs.columns if c != "shard"]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(got.select(names).collect(), key=key) == sorted(docs.select(names).collect(), key=key)
    laws(got, 8, got.agg(F.max("shard.size")).first()[0])
    assert sh.shard(empty.withColumn("lang", F.lit("")), 8).count() == 0
    assert sh.shard(empty.withColumn("lang", F.lit("")), target_bytes=5).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(made_rows(20), "doc_id long, source string, lang string, text string")
    assert "Python" not in sh.shard(docs, 4)._jdf.queryExecution().toString()


def test_first_letters_keep_the_order(spark):
    names = [None, "", "a", "ab", "b", "é", "日本語", "zebra", "zebras"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(sh.first_letters("n")).collect()]
    assert got == [letters(n) for n in names]
    bytewise = sorted((n for n in names if n is not None), key=str.encode)
    assert sorted(bytewise, key=letters) == bytewise
