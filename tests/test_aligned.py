"""Names in two styles, headers behind blank lines, regions by statistics, and aligned reads by hand."""

import pytest
from pyspark.sql import functions as F

from strandwise.functions import coords
from strandwise.operators import naming_styles as NS
from strandwise.operators.selection import pick_regions
from strandwise.plans.aligned_reads import aligned_reads, aligned_training
from strandwise.sources import readers as S


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "chr string")


def test_keys_and_kept_chromosomes(spark):
    df = names(spark, "chr1", "1", "CHR1", "chrMT", "M", "chr", "chrX", "y", "chr7_KI27_alt", "GL000219.1", None)
    got = df.select(coords.chromosome_key(F.col("chr")), coords.is_kept_chromosome(F.col("chr")), coords.is_kept_chromosome(F.col("chr"), False)).collect()
    assert [r[0] for r in got] == ["1", "1", "1", "M", "M", "CHR", "X", "Y", "7_KI27_ALT", "GL000219.1", None]
    assert [bool(r[1]) for r in got] == [True, True, True, False, False, False, False, False, True, False, False]
    assert [bool(r[2]) for r in got][6:8] == [True, True]


@pytest.mark.parametrize("sent", [0, 100_000])
def test_harmonised_names(spark, monkeypatch, sent):
    monkeypatch.setattr(NS, "SENT_NAMES", sent)
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["1", "chr1", "MT", "chrY", "odd", None, "2"])], "i int, chr string")
    got = [r.chr for r in NS.harmonise(rows, names(spark, "chr1", "chrM", "Y", "2", "chr2")).orderBy("i").collect()]
    assert got == ["chr1", "chr1", "chrM", "Y", "odd", None, "2"]
    assert NS.harmonise(rows.where("false"), names(spark, "chr1")).count() == 0
    assert [r.chr for r in NS.harmonise(rows, names(spark)).orderBy("i").collect()][:2] == ["1", "chr1"]


def test_header_behind_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n" * 40 + "chr,start,end,startCpG,endCpG,Type\nchr1,5,9,1,2,A\n")
    (tmp_path / "b.csv").write_text("  \n\nType,chr,start,end,startCpG,endCpG\n\nB,chr2,6,8,3,4\n")
    got = S.read_regions(spark, str(tmp_path)).collect()
    assert sorted((r.chr, r.start, r.cell_type) for r in got) == [("chr1", 5, "A"), ("chr2", 6, "B")]
    (tmp_path / "c.csv").write_text("\n\n  \n")
    with pytest.raises(ValueError, match="c.csv"):
        S.read_regions(spark, str(tmp_path))


def test_statistics_file_without_positions(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("chr\tstart\tareaStat\n1\t2\t3\n")
    with pytest.raises(ValueError, match="end"):
        S.read_statistics_regions(spark, str(tmp_path))


def test_own_region_ids_and_ties(spark):
    rows = [("A", 1.0, 0), ("B", 9.0, 1), ("A", 1.0, 2), ("A", 7.0, 3), ("B", None, 4), (None, 8.0, 5)]
    df = spark.createDataFrame(rows, "ctype string, statistic double, row_no long")
    ids = lambda d: {r.row_no: r.dmr_id for r in d.collect()}
    assert ids(pick_regions(df)) == {1: 0, 5: 1, 3: 2, 0: 3, 2: 4, 4: 5}
    assert ids(pick_regions(df, 2)) == {1: 0, 4: 1, 5: 2, 3: 3, 0: 4}
    own = df.withColumn("dmr_id", F.col("row_no") + 100)
    assert ids(pick_regions(own, 1)) == {1: 101, 5: 105, 3: 103}


def test_aligned_reads_by_hand(spark):
    genome = spark.createDataFrame([("chr1", 0, "AACGTTACGT"), ("chr1", 1, "TTCGAACGTA")], "chr string, chunk_id long, seq string")
    regions = spark.createDataFrame([(0, "1", 0, 12, "T"), (1, "chr1", 5, 20, "U"), (2, "chr9", 0, 50, "T"), (3, "1", 4, 4, "T")], "dmr_id long, chr string, start long, end long, ctype string")
    reads = [
        ("in_first", 0, "1", 0, "8M", "..Z...z."), ("in_second", 16, "chr1", 10, "10M", "...z...Z.."),
        ("over_the_end", 0, "1", 8, "8M", "....Z..."), ("no_call", 0, "1", 0, "8M", "........"), ("bad", 0, "1", 0, "8M", "..x...z."),
        ("elsewhere", 0, "2", 0, "8M", "..Z...z."), ("empty", 0, "1", 3, "8S", "zzzzzzzz"),
    ]
    alignments = spark.createDataFrame(reads, "qname string, flag int, chr string, pos long, cigar string, xm string")
    got = {(r.name, r.dmr_label): (r.dna_seq, r.methyl_seq, r.ctype, r.dmr_ctype) for r in aligned_reads(alignments, regions, genome, 10).collect()}
    assert got == {
        ("in_first", 0): ("AAC ACG CGT GTT TTA", "21222", "NA", "T"),  # AAZGTTzG, the last window is left out
        ("in_second", 1): ("TTC TCG CGA GAA AAC ACG CGT", "2022212", "NA", "U"),
        ("over_the_end", 1): ("GTT TTT TTC TCG CGA", "22212", "NA", "U"),
    }
    with pytest.raises(ValueError):
        aligned_reads(alignments, regions, genome, 10, span="other")
    assert aligned_reads(alignments.where("false"), regions, genome, 10).count() == 0


def test_files_stay_on_one_side(spark):
    genome = spark.createDataFrame([("1", 0, "AACGTTACGT" * 10)], "chr string, chunk_id long, seq string")
    regions = spark.createDataFrame([("1", 0, 100, "T", None, 0)], "chr string, start long, end long, ctype string, statistic double, row_no long")
    rows = [(f"r{i}", 0, "chr1", 10 * (i % 9), "8M", "..Z...z.", f"f{i % 10}", "A") for i in range(200)]
    alignments = spark.createDataFrame(rows, "qname string, flag int, chr string, pos long, cigar string, xm string, filename string, ctype string")
    got = aligned_training(alignments, regions, genome, 100, ratios=(0.5, 0.3, 0.2), by="filename")
    sides = got.groupBy("filename").agg(F.collect_set("side").alias("s"), F.count("*").alias("n")).collect()
    assert len(sides) == 10 and all(len(r.s) == 1 and r.n == 20 for r in sides)
    assert sorted(r.s[0] for r in sides) == ["test"] * 2 + ["train"] * 5 + ["valid"] * 3
