import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandwise.operators import balancing as B, combine, dedup as D, splitting as S
from strandwise.plans.make_split import make_split

SCHEMA = "row_id string, sample_id string, dna_seq string, methyl_seq string, dmr_label int, ctype string, dmr_ctype string, read_count string"


@pytest.fixture(scope="module")
def reads(spark):
    rnd, rows = random.Random(4), []
    for i in range(900):
        k = 0 if rnd.random() < 0.3 else rnd.randint(1, 200)  # one sequence holds a third of the rows
        t = rnd.choice(["A", "A", "A", "B", "C"])
        rows.append((f"{i:05d}", f"{t}{rnd.randint(0, {'A': 4, 'B': 1, 'C': 0}[t])}", f"d{k}", f"m{k % 3}", k % 11, t, "ABCD"[k % 4], rnd.choice(["1", "2", "3", "x", None])))
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_stratified_counts_are_exact(reads):
    for r in S.split_stratified(reads, 0.8).groupBy("ctype").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "train").alias("t")).collect():
        assert r["t"] == int(r["n"] * 0.8)


def test_random_split_is_exact_and_whole(reads):
    s = S.split_random(reads, 0.75)
    assert s.count() == reads.count() and s.where("side = 'train'").count() == int(reads.count() * 0.75)


def test_sequences_stay_together_within_a_type(reads):
    s = S.split_by_sequence(reads)
    assert s.count() == reads.count()
    assert s.groupBy("ctype", "dna_seq", "methyl_seq").agg(F.count_distinct("side").alias("n")).where("n > 1").count() == 0
    for t in "ABC":
        rows = s.where(F.col("ctype") == t)
        n, hot = rows.count(), rows.where("dna_seq = 'd0'").count()
        assert abs(rows.where("side = 'train'").count() - 0.75 * n) <= max(hot, 10) / 2 + 1


def test_leak_check(reads):
    s = S.split_by_sequence(reads.where("ctype = 'B'"))
    got = combine.leak_check(s.where("side = 'train'"), s.where("side = 'test'")).first()
    assert got["shared_keys"] == 0 and got["train_keys"] > got["test_keys"] > 0


@pytest.mark.parametrize("sizes, plans", [
    ([42, 30, 10, 10, 8], "train train test test test"),  # 72% is close enough
    ([25, 25, 25, 25], "train train train test"),
    ([50, 40, 5, 5], "train split test test"),  # 50% whole, the 40 fills up to 75%
    ([30, 30, 40], "split split split"),
])
def test_sample_assignment(spark, sizes, plans):
    rows = [(f"s{i}", "T", "1") for i, n in enumerate(sizes) for _ in range(n)]
    got = S.sample_assignment(spark.createDataFrame(rows, "sample_id string, ctype string, read_count string")).orderBy("sample_id").collect()
    assert [r["plan"] for r in got] == plans.split()
    if plans == "train split test test":
        assert got[1]["share"] == pytest.approx(25 / 40)


def test_split_by_sample_is_whole(reads):
    s = S.split_by_sample(reads)
    assert s.count() == reads.count()
    whole = s.where("ctype = 'A'").groupBy("sample_id").agg(F.count_distinct("side").alias("n"))
    assert whole.where("n > 1").count() <= 1


def test_three_way_split(reads):
    with pytest.raises(ValueError):
        S.split_train_valid_test(reads, (0.5, 0.5, 0.5), "dna_seq")
    s = S.split_train_valid_test(reads, (0.6, 0.2, 0.2), "dna_seq")
    assert s.count() == reads.count() and {r["side"] for r in s.select("side").distinct().collect()} == {"train", "valid", "test"}
    assert s.groupBy("dna_seq").agg(F.count_distinct("side").alias("n")).where("n > 1").count() == 0
    assert S.split_train_valid_test(reads, (1.0, 0.0, 0.0), "dna_seq").where("side <> 'train'").count() == 0


def test_keep_first_normalises_counts(spark):
    rows = [("1", "s", "d", "m", 0, "T", "T", "5"), ("2", "s", "d", "m", 0, "T", "T", "7"), ("3", "s", "d", "n", 0, "T", "T", "x"), ("4", "u", "d", "m", 0, "T", "T", "0")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["row_id"], r["read_count"]) for r in D.keep_first(df).collect()) == [("1", "1"), ("3", "x")]
    assert sorted((r["row_id"], r["read_count"]) for r in D.keep_first(df, per_sample=True).collect()) == [("1", "1"), ("3", "x"), ("4", "0")]


def twin_groups(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["row_id"]):
        groups[(r["dna_seq"], r["methyl_seq"], r["dmr_label"], r["dmr_ctype"], r["read_count"] or "1")].append(r)
    return groups


def test_cross_sample_dedup(reads):
    want = {g[0]["row_id"] for g in twin_groups(reads.collect()).values() if len({r["ctype"] for r in g}) == 1}
    assert {r["row_id"] for r in D.dedup_cross_sample(reads).collect()} == want


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_shared_by_all_dedup(reads, hot_rows):
    rows = reads.collect()
    every, want = {r["ctype"] for r in rows}, set()
    for g in twin_groups(rows).values():
        if {r["ctype"] for r in g} == every:
            want |= set()  # several labels, all dropped
        else:
            want |= {r["row_id"] for r in g}
    got = D.dedup_shared_by_all(reads.withColumn("lane", F.col("ctype")), sample="lane", hot_rows=hot_rows)
    assert {r["row_id"] for r in got.collect()} == want and 0 < len(want) < len(rows)


def test_expand_counts(spark):
    df = spark.createDataFrame([("a", "3"), ("b", "0"), ("c", "-2"), ("d", "x"), ("e", None)], "id string, read_count string")
    got = {r["id"]: r["n"] for r in D.expand_counts(df).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 3, "b": 1, "c": 1, "d": 1, "e": 1}


def weight_of(r):
    try:
        return int(r["read_count"])
    except (TypeError, ValueError):
        return 1


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_balance_against_direct_rule(reads, hot_rows):
    """The rule walked by hand, with the library's order of equal weights."""
    from hashlib import md5

    by_sample, want = defaultdict(list), set()
    for r in sorted(reads.collect(), key=lambda r: r["row_id"]):
        by_sample[r["sample_id"]].append(r)
    for rows in by_sample.values():
        own, groups = rows[0]["ctype"], defaultdict(list)
        for r in rows:
            groups[(r["dna_seq"], r["methyl_seq"])].append(r)
        w = {k: sum(map(weight_of, g)) for k, g in groups.items()}
        kind = {k: g[0]["dmr_ctype"] for k, g in groups.items()}
        keep = {k for k in groups if kind[k] == own}
        positive, allocated = sum(w[k] for k in keep), 0
        if positive == 0:
            want |= {r["row_id"] for r in rows}
            continue
        total = sum(w[k] for k in groups if kind[k] != own)
        names = sorted({kind[k] for k in groups if kind[k] != own})
        order = lambda k: (w[k], md5((md5("|".join(k).encode()).hexdigest() + "|42").encode()).hexdigest())
        for name in names:
            mine = sorted((k for k in groups if kind[k] == name), key=order)
            have = sum(w[k] for k in mine)
            goal = positive - allocated if name == names[-1] else round(have / total * positive)
            goal, got = max(0, min(goal, have, positive - allocated)), 0
            for k in mine:
                if got + w[k] > goal:
                    break
                keep.add(k)
                got += w[k]
            allocated += got
        want |= {r["row_id"] for k in keep for r in groups[k]}
    assert {r["row_id"] for r in B.balance_on_target(reads, hot_rows=hot_rows).collect()} == want


def test_batches(spark):
    rows = [(f"{t}{i}", t) for t, n in (("a", 50), ("b", 7), ("c", 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id string, ctype string")
    got = B.balanced_batches(df, 15).collect()  # quota 5, two batches, b and wraps once
    assert len(got) == 30
    assert {(r["batch"], r["ctype"]): None for r in got}.keys() == {(b, t) for b in (0, 1) for t in "abc"}
    counts = defaultdict(int)
    for r in got:
        counts[(r["batch"], r["ctype"], r["slot"])] += 1
    assert set(counts.values()) == {1} and len({r["row_id"] for r in got if r["ctype"] == "b"}) == 7
    assert B.balanced_batches(df, 15, drop_last=True).count() == 15


def test_make_split_modes(reads):
    with pytest.raises(ValueError):
        make_split(reads, "nothing")
    rows = reads.withColumn("dna_seq", F.repeat(F.lit("AAA "), 30)).withColumn("dna_seq", F.rtrim("dna_seq")).withColumn("methyl_seq", F.repeat(F.lit("2"), 30))
    out = make_split(rows, "stratified", longest=20)
    known = rows.where(F.col("dmr_ctype").isin("A", "B", "C")).count()
    assert out.count() == 2 * known and out.where(F.length("methyl_seq") != 15).count() == 0
    assert make_split(rows, "sample", shortest=31).count() == 0
    assert make_split(reads, "sequence", balance=True, shortest=1).count() > 0
