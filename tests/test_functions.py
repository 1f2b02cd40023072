import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandwise.functions import alignments as AL, coords, naming as N, reads as X, tokens as T, vectors as V
from strandwise.functions.pieces import split_long


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def nearest_in_place(pattern):
    chars = list(pattern)
    for i, c in enumerate(chars):
        if c == ".":
            left = next(((i - j, chars[j]) for j in range(i - 1, -1, -1) if chars[j] in "CT"), None)
            right = next(((j - i, chars[j]) for j in range(i + 1, len(chars)) if chars[j] in "CT"), None)
            best = left if left and (not right or left[0] <= right[0]) else right
            chars[i] = best[1] if best else c
    return "".join(chars)


def test_impute_missing_equals_nearest_rule(spark):
    patterns = ["".join(p) for n in range(0, 7) for p in itertools.product("CT.", repeat=n)]
    got = dict(one(spark, [(p,) for p in patterns], "p string", "p", X.impute_missing(F.col("p"))))
    assert got == {p: nearest_in_place(p) for p in patterns}


def test_kmers(spark):
    rows = [("",), ("AC",), ("acg",), ("ACGTN",), ("ACxGT",)]
    got = dict((r[0], r[1:]) for r in one(spark, rows, "s string", "s", X.kmers(F.col("s")), X.kmers(F.col("s"), drop_last=True)))
    assert got == {"": ("", ""), "AC": ("", ""), "acg": ("ACG", ""), "ACGTN": ("ACG CGT GTN", "ACG CGT"), "ACxGT": ("ACN CNG NGT", "ACN CNG")}


def walk_context(seq, c, g):
    start = c
    for i in range(1, 11):
        if c - i < 0 or seq[c - i : c - i + 2] == "CG":
            break
        start = c - i
    end = g
    for i in range(1, 11):
        if g + i >= len(seq) - 1 or seq[g + i - 1 : g + i + 1] == "CG":
            break
        end = g + i
    return start, end


def test_context_span_equals_walk(spark):
    rnd, rows = random.Random(2), []
    while len(rows) < 300:
        seq = "".join(rnd.choice("ACGCG" if rnd.random() < 0.5 else "AT") for _ in range(rnd.randint(4, 60)))
        sites = [i for i in range(1, len(seq) - 1) if seq[i : i + 2] == "CG"]
        if sites:
            a, b = sorted((rnd.choice(sites), rnd.choice(sites)))
            rows.append((seq, a, b + 1))
    low, high = X.context_span(F.col("s"), F.col("c"), F.col("g"))
    for seq, c, g, lo, hi in one(spark, rows, "s string, c int, g int", "s", "c", "g", low, high):
        assert (lo, hi) == walk_context(seq, c, g), (seq, c, g)


def halves(n, longest):
    return [n] if n <= longest else halves(n // 2, longest) + halves(n - n // 2, longest)


@pytest.mark.parametrize("longest", [1, 7, 250])
def test_half_lengths(spark, longest):
    sizes = [1, 24, 25, 250, 251, 501, 1001, 1003, 4000]
    for n, got in one(spark, [(n,) for n in sizes], "n int", "n", X.half_lengths(F.col("n"), longest)):
        assert got == halves(n, longest)


def test_split_long_keeps_tokens_and_calls_together(spark):
    n = 501
    tokens, calls = [f"t{i}" for i in range(n)], "".join(str(i % 3) for i in range(n))
    df = spark.createDataFrame([(" ".join(tokens), calls), ("a b", "01")], "dna_seq string, methyl_seq string")
    rows = sorted(split_long(df).collect(), key=lambda r: (-len(r["dna_seq"]) if r["dna_seq"] == "a b" else 0, r["piece"]))
    long = [r for r in rows if r["dna_seq"] != "a b"]
    assert [len(r["methyl_seq"]) for r in long] == [250, 125, 126]
    assert " ".join(r["dna_seq"] for r in long).split(" ") == tokens and "".join(r["methyl_seq"] for r in long) == calls
    assert all(len(r["dna_seq"].split(" ")) == len(r["methyl_seq"]) for r in rows)


def test_methyl_string(spark):
    cpgs = "array<struct<pos: bigint, state: string>>"
    rows = [([(12, "1"), (15, "0")], 10, 8), ([(10, "1"), (11, "0")], 10, 4), ([], 5, 3)]
    got = one(spark, rows, f"c {cpgs}, o bigint, n int", X.methyl_string(F.col("c"), F.col("o"), F.col("n")))
    assert got == [("21220222",), ("0222",), ("222",)]


def test_fragment_span(spark):
    got = one(spark, [("C..T",), ("T.",)], "p string", coords.fragment_end(F.lit(10), F.col("p")), coords.fragment_end(F.lit(10), F.col("p"), "pattern"))
    assert got == [(11, 13), (10, 11)]


def test_vocabulary_and_encoding(spark):
    assert len(T.VOCABULARY) == 69 and T.VOCABULARY[5] == "AAA" and T.VOCABULARY[68] == "TTT"
    ids, states = T.encode(F.col("d"), F.col("m"), 4)
    got = one(spark, [("AAA AAC", "01"), ("AAA AAC AAG AAT TTT", "01012"), ("NNN", "2")], "d string, m string", ids, states)
    assert got[0] == ([3, 5, 6, 2, 0], [2, 0, 1, 2, 2])
    assert got[1] == ([3, 5, 6, 7, 2], [2, 0, 1, 0, 2])
    assert got[2] == ([3, 1, 2, 0, 0], [2, 2, 2, 2, 2])


def test_mask_tokens_properties(spark):
    ids = [5 + i % 64 for i in range(40)] + [0] * 10
    df = spark.createDataFrame([(i, ids) for i in range(200)], "k int, ids array<int>")
    rows = df.select(T.mask_tokens(F.col("ids"), F.col("k")).alias("m")).select("m.*").collect()
    centres = sum(sum(r["centres"]) for r in rows)
    assert 0.12 < centres / (200 * 40) < 0.18
    for r in rows:
        assert len(r["inputs"]) == len(r["labels"]) == len(r["centres"]) == 51
        assert r["inputs"][0] == T.SOS and r["inputs"][40] == T.EOS and r["inputs"][41:] == [0] * 10
        for i in range(50):
            near = any(r["centres"][j + 1] for j in range(max(0, i - 1), min(39, i + 1) + 1) if j < 40)
            masked = r["labels"][i + 1] != T.IGNORED
            assert masked == (near and i < 40) and (not masked or r["labels"][i + 1] == ids[i])
            if not masked and i != 39:
                assert r["inputs"][i + 1] == ids[i]


def test_names(spark):
    names = ["Adipocytes_T7.csv", "x/Bone_marrow-Erythrocyte_RF_250.csv", "Blood-T_3.csv", "plain.csv", "Blood-T-Eff-CD8_41Q_250.csv"]
    got = dict(one(spark, [(n,) for n in names], "n string", "n", N.sample_id_from_name(F.col("n"))))
    assert got == {
        names[0]: "GSM5652176_Adipocytes-Z000000T7.hg38.pat.gz", names[1]: "GSM5652XXX_Bone-marrow-Erythrocyte-Z000000RF.hg38.pat.gz",
        names[2]: "GSM5652277_Blood-T-CD3-Z0000003.hg38.pat.gz", names[3]: None, names[4]: "GSM5652XXX_Blood-T-Eff-CD8-Z00000041Q.hg38.pat.gz",
    }
    assert one(spark, [("Blood-B:Ovary Ep",)], "n string", N.canonical(F.col("n")), N.matches_any(F.col("n"), ["ovary_ep"])) == [("bloodbovaryep", True)]


def test_bismark(spark):
    rows = [
        ("ACGTCG", "..Z.z.", "6M", 0), ("ACGTCG", ".Z..z.", "6M", 0), ("ACGTCG", "..Z..z", "6M", 16), ("ACGTCG", ".Z..z.", "6M", 1024),
        ("ACGTCG", "......", "6M", 0), ("ACGTCG", ".x..z.", "6M", 0), ("ACGTCG", "h.Z..z", "1M1D4M1S", 0), ("ACTT", "z...", "4M", 0),
    ]
    got = one(spark, rows, "r string, x string, c string, f int", AL.decode_bismark("r", "x", "c", "f").alias("d"))
    assert [(g[0]["bases"], g[0]["failed"]) for g in got] == [
        ("ACGTzG", False), ("AZGTzG", False), ("AZGTzG", False), (None, False), (None, False), (None, True), ("ACGTCG", False), (None, False),
    ]


def test_losses_and_softmax(spark):
    import math

    z, y = [1.0, -2.0, 0.5], 2
    e = [math.exp(v) for v in z]
    p = [v / sum(e) for v in e]
    s = lambda v: 1 / (1 + math.exp(-v))
    ce = -math.log(p[y])
    ovr = sum(0.9 * (1 - s(v)) * math.log(1 + math.exp(-v)) if i == y else s(v) * math.log(1 + math.exp(v)) for i, v in enumerate(z))
    got = one(spark, [(z, y)], "z array<double>, y int", V.softmax(F.col("z")), V.cross_entropy(F.col("z"), F.col("y")),
              V.focal_loss(F.col("z"), F.col("y")), V.one_vs_rest_focal_loss(F.col("z"), F.col("y"), alpha_pos=[0.9] * 3))[0]
    assert got[0] == pytest.approx(p) and got[1] == pytest.approx(ce) and got[2] == pytest.approx((1 - p[y]) ** 2 * ce) and got[3] == pytest.approx(ovr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k, drop_last", [(1, False), (3, False), (3, True), (5, True)])
def test_kmers_of_every_length_without_lists(spark, k, drop_last):
    lost = k if drop_last else k - 1
    texts = ["", "a", "acgt\nxACGTé", "straße", "日", "\U0001f600acgtac", *["ACGTTGCAN"[i % 9 :] * 8 for i in range(9)], *["ACGGT" * 9][:1], "AC" * 9, *["ACGTTGCA"[: i % 8] + "GATTACA" * (i // 8) for i in range(40)]]
    rows = [(t,) for t in texts] + [(None,)]
    for text, got in one(spark, rows, "s string", "s", X.kmers(F.col("s"), k, drop_last)):
        clean = "".join(c if c in "ACGT" else "N" for c in (text or "").upper())
        want = [clean[i : i + k] for i in range(len(clean) - lost)] if len(text or "") > lost else []
        assert got == " ".join(want), text
    df = spark.createDataFrame(rows, "s string").select(X.kmers(F.col("s"), k, drop_last))
    assert "lambda" not in plan(df)


def test_split_long_cuts_even_and_uneven_tokens_alike(spark):
    calls = "".join(str(i % 3) for i in range(30))
    tokens = ["ACG", "CGT", "GTA"] * 10
    texts = {"even": " ".join(tokens), "uneven": " ".join(tokens[:29] + ["A"]), "short": " ".join(tokens[:20]), "long": " ".join(tokens + ["TTT"]),
             "gap": "ACG  CGT " + " ".join(tokens[:27]), "end": " ".join(tokens[:29]) + " AC\n", "empty": "", "none": None}
    df = spark.createDataFrame([(k, t, calls) for k, t in texts.items()] + [("no-calls", "ACG", None), ("whole", "x  y", "012")], "name string, dna_seq string, methyl_seq string")
    got = {(r["name"], r["piece"]): (r["dna_seq"], r["methyl_seq"]) for r in split_long(df, 8).collect()}
    want = {("whole", 0): ("x  y", "012")}
    for name, text in texts.items():
        at = 0
        for piece, n in enumerate(halves(30, 8)):
            want[name, piece] = (None if text is None else " ".join(text.split(" ")[at : at + n]), calls[at : at + n])
            at += n
    assert got == want
    assert "split(dna_seq" not in plan(split_long(df, 8)).split("Generate")[0]  # tokens are found before the pieces, not for each
