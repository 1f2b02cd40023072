from collections import defaultdict

from pyspark.sql import functions as F

from strandwise.llm.mixing import apply_mix, mix, source_targets, word_count


def test_targets_by_force(spark):
    sizes = {"a": 5, "b": 100, "c": 7, "d": 400, None: 50}
    docs = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(docs, F.col("size")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    total, target = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in target]
        level = (total - sum(target.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
    target |= {s: weight[s] * level for s in rest}
    assert {s: round(t, 6) for s, t in got.items()} == {s: round(t, 6) for s, t in target.items()}


def test_budgets_are_met_and_reruns_agree(spark):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text")
    )
    run = lambda: mix(docs, word_count("text")).select("doc_id", "source", "mix.*").collect()
    first = run()
    assert sorted(first) == sorted(run())
    taken, target = defaultdict(int), {}
    for r in first:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_applied_mix_holds_what_is_taken(spark):
    docs = spark.createDataFrame([(1, "a", "one two  three"), (2, "a", "x y"), (3, "b", "p q r s t u v w"), (4, None, None)], "doc_id long, source string, text string")
    mixed = mix(docs, word_count("text"))
    want = {r.doc_id: r.taken for r in mixed.select("doc_id", "mix.taken").collect()}
    got = apply_mix(mixed)
    assert got.columns == docs.columns
    words = defaultdict(int)
    for r in got.collect():
        words[r.doc_id] += len((r.text or "").split())
    assert {k: v for k, v in want.items() if v} == dict(words)


def test_hostile_rows(hostile, empty):
    got = mix(hostile, word_count("text"))
    assert got.count() == hostile.count() and set(got.columns) == set(hostile.columns)
    assert got.where("mix.taken > 2 * mix.size").count() == 0
    assert mix(empty, word_count("text")).count() == 0
    assert apply_mix(mix(empty, word_count("text"))).count() == 0
