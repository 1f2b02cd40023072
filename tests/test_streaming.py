import pytest
from pyspark.sql import functions as F

from strandwise.plans.build_reads import build_reads, prepare_regions
from strandwise.sources.readers import read_fragments
from strandwise.streaming.ingest import ingest_samples, read_ingested, running_composition, stream_fragments

GENOME = "TTACGTTACGAACGTTTTTTTTTTTTACGA" + "T" * 34


def tables(spark):
    genome = spark.createDataFrame([("chr1", i // 16, GENOME[i : i + 16]) for i in range(0, len(GENOME), 16)], "chr string, chunk_id bigint, seq string")
    sites = [i + 1 for i in range(len(GENOME)) if GENOME[i : i + 2] == "CG"]
    cpg = spark.createDataFrame([("chr1", p, i + 1) for i, p in enumerate(sites)], "chr string, pos bigint, cpg_idx bigint")
    regions = spark.createDataFrame([(0, "chr1", 1, 40, "A"), (1, "chr1", 4, 20, "B")], "dmr_label int, chr string, start bigint, end bigint, cell_type string")
    samples = spark.createDataFrame([("s1", "A"), ("s2", "B")], "sample_id string, ctype string")
    return genome, cpg, regions, samples


def test_build_by_hand(spark):
    genome, cpg, regions, _ = tables(spark)
    f = spark.createDataFrame([("s", "A", "chr1", 1, 2, "C.T", 4), ("s", "A", "chr1", 1, 2, "CCT", 1)],
                              "sample_id string, ctype string, chr string, cpg_start bigint, cpg_end bigint, pattern string, read_count int")
    rows = {r["dmr_label"]: r for r in build_reads(f, regions.where("dmr_label = 0"), cpg, genome, 16).collect()}
    # CpGs at 4 and 9 are covered; the third one at 13 stops the right flank on its C
    bases = "TTACGTTACGAAC"
    assert rows[0]["dna_seq"] == " ".join(bases[i : i + 3] for i in range(11))
    assert rows[0]["methyl_seq"] == "22122221222" and rows[0]["read_count"] == 5
    # the CpG on the first base of region 1 has no 3-mer, so its read starts after it
    second = build_reads(f, regions.where("dmr_label = 1"), cpg, genome, 16).first()
    assert second["methyl_seq"].count("1") == 1 and len(second["dna_seq"].split(" ")) == len(second["methyl_seq"])
    assert build_reads(f, regions, cpg, genome, 16, collapse=False).where("dmr_label = 0").count() == 5


@pytest.mark.parametrize("files", [1, 2, 64])
def test_ingest_equals_batch(spark, tmp_path, files):
    genome, cpg, regions, samples = tables(spark)
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    marked = prepare_regions(regions, cpg, genome, 16)

    def drain():
        arriving = stream_fragments(spark, str(src), files).drop("sample_id").withColumnRenamed("sample", "sample_id")
        q = ingest_samples(arriving, samples, marked, out, ck)
        q.awaitTermination()
        assert q.exception() is None

    def put(sample, name, text):
        (src / f"sample={sample}").mkdir(exist_ok=True)
        (src / f"sample={sample}" / name).write_text(text)

    put("s1", "a.pat", "chr1\t1\tC.T\t4\nchr1\t2\tTT\t1\n")
    drain()
    drain()  # nothing new
    put("s2", "a.pat", "chr1\t3\tCC\t2\nbroken\n")
    for name in ("b.pat", "c.pat", "d.pat"):  # more files of one sample, in batches of their own or together
        put("s1", name, "chr1\t1\tC.T\t2\n")
    drain()
    columns = ["sample_id", "dna_seq", "methyl_seq", "dmr_label", "ctype", "dmr_ctype", "read_count"]
    got = sorted(map(tuple, read_ingested(spark, out).select(*columns).collect()))
    fragments = read_fragments(spark, str(src)).drop("sample_id").withColumnRenamed("sample", "sample_id")
    batch = build_reads(fragments.join(samples, "sample_id"), regions, cpg, genome, 16)
    assert got == sorted(map(tuple, batch.select(*columns).collect())) and {r[0] for r in got} == {"s1", "s2"}


def test_running_composition(spark, tmp_path):
    scored = spark.createDataFrame([("s", i % 3) for i in range(10)], "sample_id string, pred int")
    scored.write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(scored.schema).parquet(str(tmp_path / "p"))
    q = (running_composition(stream).writeStream.format("memory").queryName("composition").outputMode("complete")
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r["sample_id"], r["pred"]): r["n_reads"] for r in spark.table("composition").collect()}
    assert got == {(r["sample_id"], r["pred"]): r["n_reads"] for r in running_composition(scored).collect()}
    assert running_composition(scored).agg(F.sum("n_reads")).first()[0] == 10


def test_incoming_files_are_written_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """More fragments, more writing tasks: none sorts a fixed share of the table."""
    from strandwise.catalog import genome_queries as Q

    monkeypatch.setattr(Q, "FILE_ROWS", 100, raising=False)
    raw = spark.range(1000).selectExpr("'s' || id % 2 AS sample_id", "'chr1' AS chr", "id AS cpg_start", "'CT' AS pattern", "1 AS read_count")
    assert Q._incoming(raw, str(tmp_path / "many")) == 10 and Q._incoming(raw.limit(5), str(tmp_path / "few")) == 3
    back = spark.read.schema("chr string, cpg_start bigint, pattern string, read_count int").csv(str(tmp_path / "many"), sep="\t")
    assert sorted(r.cpg_start for r in back.collect()) == list(range(1000))
    sizes = [r["count"] for r in back.groupBy(F.regexp_extract("_metadata.file_path", r"part-(\d+)", 1)).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200
