"""The incremental table: folded batches, replays, a merge that fails, and what a read scans."""

import json

import pytest
from pyspark.sql import functions as F

from strandwise.operators.joins import dealt
from strandwise.sources.readers import read_fragments
from strandwise.streaming import ingest
from strandwise.streaming.ingest import compact, journal, read_ingested

SCHEMA = "sample_id string, bases string, methyl_seq string, dmr_label int, ctype string, dmr_ctype string, read_count long"


def put(spark, out, batch, *samples):
    """Batch n brings n + 1 reads of each sample."""
    rows = [(s, "ACGTA", "212", 0, "A", "A", batch + 1) for s in samples]
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{out}/open/batch={batch}")


def counts(spark, out):
    rows = read_ingested(spark, out).collect()
    assert len(rows) == len({r.sample_id for r in rows})
    return {r.sample_id: r.read_count for r in rows}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_replay_and_pruning(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(ValueError):
        read_ingested(spark, out)
    compact(spark, out, 5)  # nothing there
    samples = [f"s{i}" for i in range(12)]
    put(spark, out, 0, *samples)
    put(spark, out, 1, "s0", "s1")
    want = {s: 1 + 2 * (s in ("s0", "s1")) for s in samples}
    assert counts(spark, out) == want
    compact(spark, out, 1, buckets=8)
    compact(spark, out, 1, buckets=3)  # folded already
    assert counts(spark, out) == want and journal(spark, out)[:2] == (1, 8)
    put(spark, out, 1, "s0", "s1")  # replayed after it was folded: counts once
    assert counts(spark, out) == want
    put(spark, out, 2, "s0")
    want["s0"] += 3
    assert counts(spark, out) == want
    read = read_ingested(spark, out)
    plan = plan_of(read)
    assert plan.count("Aggregate") == 2 and "Union" in plan  # only the bucket of s0 is summed up again
    fresh = ingest._open(spark, out, 1)
    assert {r.batch for r in fresh.collect()} == {2} and "PartitionFilters: [isnotnull(batch" in plan_of(fresh) and "Filter " not in plan_of(fresh).split("FileScan")[0]
    compact(spark, out, 2)
    assert counts(spark, out) == want
    last, buckets, versions = journal(spark, out)
    assert (last, buckets) == (2, 8) and sorted(set(versions.values())) == [1, 2] and list(versions.values()).count(2) == 1
    assert "Aggregate" not in plan_of(read_ingested(spark, out))
    one = ingest._folded(spark, out, {b: v for b, v in versions.items() if v == 2})
    assert {(r.v,) for r in one.select("v").collect()} == {(2,)} and "DataFilters: []" in plan_of(one)


def test_failed_merge(spark, tmp_path, monkeypatch):
    """Files of a merge without a journal line are not read, and the next try replaces them."""
    out = str(tmp_path / "out")
    put(spark, out, 0, "s0", "s1", "s2")
    compact(spark, out, 0, buckets=4)
    put(spark, out, 1, "s0", "s1", "s2")
    before = counts(spark, out)
    create = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")) if a[-1] == ingest.JOURNAL else create(*a[1:], **k))
    with pytest.raises(OSError):
        compact(spark, out, 1)
    monkeypatch.undo()
    assert counts(spark, out) == before and journal(spark, out)[0] == 0
    put(spark, out, 2, "s1")
    compact(spark, out, 1)
    compact(spark, out, 2)
    assert counts(spark, out) == {"s0": 3, "s1": 6, "s2": 3}


def test_an_empty_batch_is_folded(spark, tmp_path):
    out = str(tmp_path / "out")
    put(spark, out, 0, "s0")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{out}/open/batch=1")
    compact(spark, out, 1)
    assert counts(spark, out) == {"s0": 1} and journal(spark, out)[0] == 1
    lines = [json.loads(x.value) for x in spark.read.text(f"{out}/journal").collect()]
    assert [(x["upto"], len(x["rewritten"])) for x in lines] == [(1, 1)]


def test_rows_of_a_gz_file_are_dealt_out(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "s1.pat.gz", "wt") as f:
        f.writelines(f"chr1\t{i}\tCT\t1\n" for i in range(1, 5001))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "s1.pat").write_text("".join(f"chr1\t{i}\tCT\t1\n" for i in range(1, 5001)))
    zipped, plain = read_fragments(spark, str(tmp_path / "s1.pat.gz")), read_fragments(spark, str(tmp_path / "plain"))
    held = [r.n for r in zipped.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(held) == 8 and max(held) < 2 * min(held)
    assert sorted(map(tuple, zipped.collect())) == sorted(map(tuple, plain.collect()))
    assert "RoundRobin" not in zipped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    same = spark.createDataFrame([("a",)] * 800, "x string").coalesce(1)
    assert dealt(same).columns == ["x"] and dealt(same).groupBy(F.spark_partition_id()).count().count() == 8
