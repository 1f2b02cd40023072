import random

import pytest
from pyspark.sql import functions as F

from strandwise.functions.keys import shuffle_key
from strandwise.operators import ordering as O
from strandwise.operators.joins import skew_join


@pytest.fixture(scope="module")
def items(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("ab"), rnd.randint(1, 9)) for i in range(600)] + [(1000 + i, "c", 5) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, g string, w int").withColumn("k", shuffle_key("id"))
    return df.cache()


def brute(rows, portion, nearest):
    out = set()
    for g in {r["g"] for r in rows}:
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["k"])
        limit, run = int(sum(r["w"] for r in mine) * portion), 0
        for r in mine:
            run += r["w"]
            if (2 * run - r["w"] <= 2 * limit) if nearest else run <= limit:
                out.add(r["id"])
            else:
                break
    return out


@pytest.mark.parametrize("nearest", [False, True])
@pytest.mark.parametrize("portion", [0.0, 0.001, 0.33, 0.75, 1.0])
@pytest.mark.parametrize("sort_rows", [1, 10**6])
def test_prefix_cuts(items, nearest, portion, sort_rows):
    cuts = O.prefix_cuts(items, ["g"], "k", lambda t: F.floor(t * portion), F.col("w"), nearest, sort_rows)
    got = {r["id"] for r in O.flag_prefix(items, cuts, ["g"], "k", "f").where("f").collect()}
    assert got == brute(items.collect(), portion, nearest)


def test_prefix_cuts_keep_one_key_together(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else str(i)) for i in range(300)], "id int, s string").withColumn("k", shuffle_key("s"))
    cuts = O.prefix_cuts(df, [], "k", lambda t: F.floor(t * 0.75), nearest=True, sort_rows=5)
    sides = O.flag_prefix(df, cuts, [], "k", "f").groupBy("s").agg(F.count_distinct("f").alias("n"))
    assert sides.where("n > 1").count() == 0


@pytest.mark.parametrize("sort_rows", [4, 10**6])
def test_rank_in_group(items, sort_rows):
    rows = O.rank_in_group(items, ["g"], "k", sort_rows=sort_rows).collect()
    for g in "abc":
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["k"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_rank_positions(spark):
    points = [("x", 5), ("x", 900), ("x", 30), ("w", 7), ("w", 1)]
    got = O.rank_positions(spark.createDataFrame(points, "c string, p bigint"), "c", "p", span=10).collect()
    assert [(r["c"], r["p"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted(points)


@pytest.mark.parametrize("span", [3, 1000])
def test_running(spark, span):
    rows = [("g", i, (i * 7) % 5, "m" if i % 4 == 2 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, p bigint, v int, m string")
    got = {r["p"]: r["s"] for r in O.running(df, ["g"], "p", "v", "s", span=span).collect()}
    assert got == {i: sum((j * 7) % 5 for j in range(i)) for i in range(20)}
    low = {r["p"]: r["s"] for r in O.running(df, ["g"], "p", "v", "s", how="min", span=span).collect()}
    assert low == {i: min(((j * 7) % 5 for j in range(i)), default=None) for i in range(20)}
    last = {r["p"]: r["s"] for r in O.running(df.withColumn("m", F.concat("m", F.col("p").cast("string"))), ["g"], "p", "m", "s", how="last", inclusive=True, span=span).collect()}
    assert last == {i: next((f"m{j}" for j in range(i, -1, -1) if j % 4 == 2), None) for i in range(20)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, how):
    big = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(200)], "id int, k string")
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4)], "k string, v int")
    want = sorted(map(tuple, big.join(other, ["k"], how).collect()), key=str)
    got = skew_join(big, other, ["k"], how, spread=["id"], hot_rows=10)
    assert sorted(map(tuple, got.select(*big.join(other, ["k"], how).columns).collect()), key=str) == want
