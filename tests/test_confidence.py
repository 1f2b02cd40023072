"""Least and most confident reads: candidate bins against a plain sort, and what the plan moves."""

import random

import pytest
from pyspark.sql import functions as F

from strandwise.operators.confidence import confidence_extremes, extreme_candidates

SCHEMA = "read_id long, true_label int, pred int, probs array<double>"


def made(n=600, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        raw = [rng.random() ** rng.choice([1, 8]) + 1e-9 for _ in range(4)]
        probs = [x / sum(raw) for x in raw]
        if i % 3 == 0:
            probs = [0.97, 0.01, 0.01, 0.01]  # one vector holds a third of the reads
        elif i % 5 == 0:
            probs = [0.4 + i % 3 * 1e-5, 0.2, 0.2, 0.2 - i % 3 * 1e-5]  # alike when rounded, not in confidence
        rows.append((i * 31 % 997, rng.choice([0, 1, None]), probs.index(max(probs)), probs))
    return rows


def plain(rows, k):
    """(kind, label, place, read) by sorting everything."""
    out = set()
    for label in {r[1] for r in rows}:
        for kind, sign in (("low", 1), ("high", -1)):
            best = {}
            for i, at, _, probs in rows:
                if at == label:
                    vector = tuple(round(x, 3) for x in probs)
                    best[vector] = min(best.get(vector, (9.0, 0)), (sign * max(probs), i))
            out |= {(kind, label, n + 1, i) for n, (_, i) in enumerate(sorted(best.values())[:k])}
    return out


@pytest.mark.parametrize("k", [1, 7, 15, 10_000])
def test_against_sorting_everything(spark, k):
    rows = made()
    got = confidence_extremes(spark.createDataFrame(rows, SCHEMA).repartition(6), k, k).collect()
    assert {(r.kind, r.true_label, r.place, r.read_id) for r in got} == plain(rows, k)
    by_id = {r[0]: r for r in rows}
    assert all(r.confidence == max(by_id[r.read_id][3]) and r.pred == by_id[r.read_id][2] for r in got)


def test_rows_without_probabilities_and_repeats(spark):
    df = spark.createDataFrame([(1, 0, 0, [0.6, 0.4]), (1, 0, 0, [0.6, 0.4]), (2, 0, 0, None), (3, 0, 0, [])], SCHEMA)
    got = confidence_extremes(df).collect()
    assert sorted((r.kind, r.place, r.read_id) for r in got) == [("high", 1, 1), ("low", 1, 1)]
    assert confidence_extremes(df.where("false")).count() == 0


def test_no_vector_is_shuffled(spark):
    df = spark.createDataFrame(made(50), SCHEMA)
    plan = extreme_candidates(df, 15, 15)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortAggregate" not in plan
    assert extreme_candidates(df, 3, 3).agg(F.count("*")).first()[0] < 50
