import gzip
import json

import pytest

from pyspark.sql import functions as F

from strandwise.sources import readers as S, writers as W
from strandwise.sources.headers import resolve_columns, split_header


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_fragments(spark, tmp_path):
    lines = ["chr1\t10\tC.T\t3", "chr1\t20\t..\t1", "chr1\t30", "", "chr2\t5\tT\t2\textra", "chr2\tx\tC\t1"]
    with gzip.open(tmp_path / "s1.pat.gz", "wt") as f:
        f.write("\n".join(lines))
    got = S.read_fragments(spark, str(tmp_path / "s1.pat.gz"))
    assert rows(got) == [("s1", "chr1", 10, "C.T", 3, 11), ("s1", "chr2", 5, "T", 2, 5)]
    assert rows(S.read_fragments(spark, str(tmp_path), span="pattern"), "cpg_end") == [(12,), (5,)]


def test_regions(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("chr,start,end,Type\nchrX,1,5,A\nchr2_alt,10,20, B\nchr1,100,110,A\nchr1,300,310,A\n")
    with pytest.raises(ValueError):
        S.read_regions(spark, str(p))
    cpg = spark.createDataFrame([("chr2", 20, 7), ("chr1", 100, 1), ("chr1", 110, 2)], "chr string, pos bigint, cpg_idx bigint")
    got = S.read_regions(spark, str(p), cpg)
    assert rows(got, "dmr_label", "chr", "cpg_start", "cpg_end", "cell_type") == [(1, "chr2", 7, 7, "B"), (2, "chr1", 1, 2, "A")]
    assert rows(S.read_regions(spark, str(p), cpg, target_type="A"), "dmr_label") == [(2,)]


def test_reference(spark, tmp_path):
    a, b = "acgtN" * 7 + "ac", "GGC"
    p = tmp_path / "g.fa"
    p.write_text(">one desc\n" + "\n".join(a[i : i + 8] for i in range(0, len(a), 8)) + "\n\n> two\n" + b + "\n")
    got = {(r["chr"], r["chunk_id"]): r["seq"] for r in S.read_reference(spark, str(p), 5).collect()}
    want = {("one", i // 5): a.upper()[i : i + 5] for i in range(0, len(a), 5)} | {("two", 0): "GGC"}
    assert got == want


def test_sectioned(spark, tmp_path):
    head = "DNA_seq,Methyl_seq,DMR_Label,cType,DMR_cType,Read_Count"
    r = lambda i, n=6: ",".join([f"A{i}", "01", str(i), "T", "T", "2"][:n])
    p = tmp_path / "c.csv"
    p.write_text("\n".join([head, r(0), "x.pat.gz", r(1), r(2, 4), r(3, 5), "empty.pat.gz", "y.pat.gz", r(4), "x.pat.gz", r(5)]))
    got = S.read_sectioned(spark, str(p))
    assert rows(got, "sample_id", "dna_seq", "read_count") == [
        ("x.pat.gz", "A1", "2"), ("x.pat.gz", "A3", None), ("x.pat.gz", "A5", "2"), ("y.pat.gz", "A4", "2")]
    assert S.read_sectioned(spark, str(p), keep_unmarked=True).where("sample_id is null").count() == 1


def test_headers(spark, tmp_path):
    p = tmp_path / "h.tsv"
    p.write_text("DMR_Label\tCell_type\tMethylation\tDNA_seq\tdmr_ctype\n1\tT\t01\tAAA AAC\tU\n")
    assert split_header(p.read_text().split("\n")[0])[0] == "\t"
    assert rows(S.read_labelled_reads(spark, str(p))) == [("AAA AAC", "01", "1", "T", "U")]
    assert resolve_columns(["my_dna_seq", "methyl", "ctype", "DMR"], ("dna_seq", "methyl_seq", "ctype", "dmr_label")) == {
        "dna_seq": "my_dna_seq", "methyl_seq": "methyl", "ctype": "ctype", "dmr_label": "DMR"}
    with pytest.raises(ValueError):
        resolve_columns(["x1", "zz"], ("dna_seq",))


def test_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dna_seq,methyl_seq,dmr_label,ctype\nAAA,01,6,T1\n")
    (tmp_path / "b.csv").write_text("\nctype;dmr_label;methylation;sequence;read_count\nT2;7;10;CCC;3\n")
    got = S.read_labelled_reads(spark, str(tmp_path))
    assert rows(got) == [("AAA", "01", "6", "T1", None), ("CCC", "10", "7", "T2", "3")]
    (tmp_path / "cfdna").mkdir()
    (tmp_path / "cfdna" / "c.csv").write_text("DNA_seq,Methyl_seq,DMR_Label\nGGG,22,8\n")
    assert rows(S.read_labelled_reads(spark, str(tmp_path / "cfdna"), labelled=False)) == [("GGG", "22", "8")]
    with pytest.raises(ValueError):
        S.read_labelled_reads(spark, str(tmp_path / "cfdna"))
    regions = tmp_path / "regions"
    regions.mkdir()
    (regions / "1.csv").write_text("chr,start,end,Type,startCpG,endCpG\nchr1,1,5,A,1,2\n")
    (regions / "2.csv").write_text("Type,endCpG,startCpG,end,start,chr\nB,9,8,20,10,chr2\n")
    got = S.read_regions(spark, str(regions))
    assert rows(got, "dmr_label", "chr", "start", "end", "cpg_start", "cpg_end", "cell_type") == [
        (0, "chr1", 1, 5, 1, 2, "A"), (1, "chr2", 10, 20, 8, 9, "B")]


def test_sample_names_with_odd_signs(spark, tmp_path):
    (tmp_path / "Blood-Mono+Macro x%1.pat").write_text("chr1\t10\tC.T\t3\n")
    assert rows(S.read_fragments(spark, str(tmp_path)), "sample_id") == [("Blood-Mono+Macro x%1",)]


def test_manifest_and_bed(spark, tmp_path):
    doc = {"fasta_file": "g.fa", "collective_csv_mode": True, "cell_types": {"k": {"pat_file": "p", "output_file": "o", "cell_type": "T"}}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    assert rows(S.read_manifest(spark, str(tmp_path / "m.json")), "sample_key", "pat_file", "cell_type", "fasta_file") == [("k", "p", "T", "g.fa")]
    bed = spark.createDataFrame([("c", 1, None, 5)], "chr string, start bigint, none string, end bigint")
    kept = W.write_bed(bed, str(tmp_path / "b"))
    assert kept == ["chr", "start", "end"] and rows(S.read_bed(spark, str(tmp_path / "b"), kept)) == [("c", 1, 5)]


def test_alignments(spark, tmp_path):
    sam = ["@HD\tVN:1", "a\t0\tc\t11\t9\t3S4M\t*\t0\t0\tAAAACGT\t*\tXM:Z:...z...", "b\t1024\tc\t1\t9\t4M\t*\t0\t0\tACGT\t*\tXM:Z:.z..", "d\t0\tc\t1\t9\t4M\t*\t0\t0\tACGT\t*\tNM:i:0"]
    (tmp_path / "x.sam").write_text("\n".join(sam))
    assert rows(S.read_alignments(spark, str(tmp_path / "x.sam")), "qname", "pos", "pos_end", "xm") == [("a", 10, 14, "...z...")]


def test_composition_formats(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 2)], "sample_id string, pred int, n_reads bigint")
    W.write_composition(df, str(tmp_path / "t"), "tsv")
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first()["n_reads"] == "2"
    with pytest.raises(ValueError):
        W.write_composition(df, str(tmp_path / "t"), "xml")
    with pytest.raises(ValueError):
        W.write_reads(df, str(tmp_path / "t"), "xml")


def test_lines_stay_where_they_are_when_markers_are_few(spark, tmp_path):
    from strandwise.sources.lines import fill_from_marker, numbered_lines

    texts = {"a": ["x", "#1", "x", "x", "#2", "#3", "x"], "b": ["x", "x"], "c": ["#4"] + ["x"] * 9000 + ["#5", "x"], "d": ["#6", "#6"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines))
    lines = numbered_lines(spark, str(tmp_path))
    want = []
    for name, values in texts.items():
        last = None
        for i, v in enumerate(values):
            last = v if v.startswith("#") else last
            want.append((name, i, last))
    mark = F.when(F.col("value").startswith("#"), F.col("value"))
    for most in (100, 2):
        filled = fill_from_marker(lines, mark, "head", most)
        got = filled.select(F.regexp_extract("file", r"([^/]+)$", 1), "row_no", "head").collect()
        assert sorted(map(tuple, got), key=lambda r: r[:2]) == want
        assert ("Window" in filled._jdf.queryExecution().executedPlan().toString()) == (most == 2)


def test_sections_of_bases_read_like_sections_of_kmers(spark, tmp_path):
    from strandwise.functions.reads import kmers
    from strandwise.sources import writers as W

    rows = [(f"s{i % 3}", "ACGTTGCA"[i % 4 :] if i % 7 else None, "012", i, None if i % 5 == 0 else "T", "U", 2) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, dna_seq string, methyl_seq string, dmr_label int, ctype string, dmr_ctype string, read_count int")
    W.write_sectioned(df, str(tmp_path / "bases"), 7, bases=True)
    W.write_sectioned(df.withColumn("dna_seq", kmers(F.col("dna_seq"))), str(tmp_path / "kmers"), 7)
    a, b = (sorted(tuple(r) for r in S.read_sectioned(spark, str(tmp_path / n)).drop("row_no").collect()) for n in ("bases", "kmers"))
    assert a == b and len(a) == 60
