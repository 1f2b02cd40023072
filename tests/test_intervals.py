import random

import pytest
from pyspark.sql import functions as F

from strandwise.operators import intervals as I

PATHS = {"broadcast": {}, "shuffled": {"broadcast_rows": 0}, "salted": {"broadcast_rows": 0, "hot_rows": 5}}


def tables(spark, seed=3):
    rnd = random.Random(seed)
    left = [(i, "c1" if rnd.random() < 0.8 else "c2", s := rnd.randint(0, 400), s + rnd.choice([0, 1, 3, 120])) for i in range(150)]
    right = [(i, rnd.choice(["c1", "c2"]), s := rnd.randint(0, 400), s + rnd.choice([0, 2, 40])) for i in range(60)]
    # touching ends, a long range sorted before a short one, an empty range, equal coordinates twice
    left += [(900, "c1", 10, 20), (901, "c1", 0, 500), (902, "c1", 1, 2), (903, "c1", 9, 3)]
    right += [(900, "c1", 20, 25), (901, "c1", 5, 10), (902, "c1", 20, 25), (903, "c1", 8, 6)]
    a = spark.createDataFrame(left, "l int, chr string, ls bigint, le bigint")
    b = spark.createDataFrame(right, "r int, chr string, rs bigint, re bigint")
    return left, right, a, b


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("width", [1, 16, 1024])
def test_overlap_against_brute_force(spark, path, width):
    left, right, a, b = tables(spark)
    got = I.interval_join(a, b, ("ls", "le"), ("rs", "re"), width=width, **PATHS[path]).select("l", "r").collect()
    want = {(x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("path", PATHS)
def test_containment_against_brute_force(spark, path):
    left, right, a, b = tables(spark, 5)
    got = I.interval_join(a, b, ("ls", "le"), ("rs", "re"), width=16, contained=True, **PATHS[path]).select("l", "r").collect()
    want = {(x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= x[3] and y[2] <= x[2] and x[3] <= y[3]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_join_is_planned_as_hash_join(spark):
    _, _, a, b = tables(spark)
    for how in PATHS.values():
        plan = I.interval_join(a, b, ("ls", "le"), ("rs", "re"), **how)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_region_without_cpg_counts_zero(spark):
    regions = spark.createDataFrame([(0, "c", 1, 5, "T"), (1, "c", 50, 60, "T")], "dmr_label int, chr string, start bigint, end bigint, cell_type string")
    cpg = spark.createDataFrame([("c", 1, 7), ("c", 5, 8), ("c", 6, 9), ("d", 55, 10)], "chr string, pos bigint, cpg_idx bigint")
    ranged = I.attach_cpg_range(regions, cpg)
    rows = {r["dmr_label"]: r for r in ranged.select("*", I.cpg_count(F.col("cpg_start"), F.col("cpg_end")).alias("n")).collect()}
    assert (rows[0]["cpg_start"], rows[0]["cpg_end"], rows[0]["n"]) == (7, 8, 2)
    assert rows[1]["cpg_start"] is None and rows[1]["n"] == 0
    assert [r["dmr_label"] for r in I.require_cpgs(ranged).collect()] == [0]
