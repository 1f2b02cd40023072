"""Columns of any name keep their values, and texts or labels of any shape do not run into each other."""

import json

import pytest
from pyspark.sql import functions as F

from strandwise.llm import decontamination, embeddings, mixing, secrets, shingle_join, substrings, toxicity
from strandwise.llm.columns import fresh

NAMES = (
    "_row _key _word _bits _place _may _doc _whole _single _contamination _secrets _toxicity _cut contamination secrets "
    "cut kept row place may_go id n cls root stays copies body spans toxicity score text_ name gram"
).split()
TEXT = "the quick brown fox jumps over the lazy dog while seven wizards quietly judge my vow of silence"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [TEXT, TEXT + " again", "password = hunter2hunter2 stands here", "nothing of note in this one, really", None, "", "x" * 200, "x" * 200 + "y"]
    rows = [(i, t, "s", *[f"{n}-{i}" for n in NAMES]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))


def same(got, docs, ids, but=()):
    """The rows of these ids with all their columns in place and every value as it was."""
    assert got.columns[: len(docs.columns)] == docs.columns
    kept = [c for c in docs.columns if c not in but]
    want = {r.doc_id: r for r in docs.select(kept).collect()}
    found = got.select(kept).collect()
    assert sorted(r.doc_id for r in found) == sorted(ids) and all(r == want[r.doc_id] for r in found)


def test_fresh_names():
    assert fresh("_row", ["a", "_ROW", "__row"]) == "___row" and fresh("x", []) == "x"


def test_rows_that_stay(spark, docs):
    # repeated rows go too, but for those without words
    same(shingle_join.keep_one(docs.unionByName(docs)), docs, [0, 2, 3, 4, 4, 5, 5, 6, 7])
    bench = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    same(decontamination.remove_documents(docs, bench), docs, [2, 3, 4, 5, 6, 7])
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    same(toxicity.remove_toxic(docs, labels, threshold=1.1), docs, range(8))
    assert toxicity.remove_toxic(docs, labels, threshold=0.0).count() == 0


def test_rows_that_change(spark, docs):
    bench = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    cut = decontamination.remove_spans(docs, bench)
    same(cut, docs, range(8), but=["text"])
    assert cut.where("doc_id = 0").first().text == "" and cut.where("doc_id = 1").first().text.strip() == "again"
    clean = secrets.redact(docs)
    same(clean, docs, range(8), but=["text"])
    assert clean.where("doc_id = 2").first().text == "[secret] stands here"
    spans = substrings.repeated_spans(docs, out="spans_found")
    same(spans, docs, range(8))
    assert {r.doc_id: r.spans_found.n_removed for r in spans.collect()}[7] == 200
    mixed = mixing.apply_mix(mixing.mix(docs, mixing.word_count("text")))
    assert mixed.columns == docs.columns
    whole = {r.doc_id: r for r in docs.drop("text").collect()}
    assert all(r == whole[r.doc_id] for r in mixed.drop("text").collect())


def test_scores_agree_with_those_of_the_query(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    column = docs.select("doc_id", toxicity.scored_by(spark, model)(F.col("text")).alias("p")).collect()
    struct = {r.doc_id: r.p for r in toxicity.score(docs, model, out="t").select("doc_id", F.col("t.score").alias("p")).collect()}
    assert {r.doc_id: r.p for r in column} == struct


def test_labels_do_not_run_into_vectors(spark):
    rows = [(1, "a,1.0", [2.0]), (2, "a", [1.0, 2.0]), (3, "a", [1.0, 2.0]), (4, "", [1.0]), (5, ",1.0", [1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert {r.id: (r.n_links, r.component) for r in got} == {1: (0, 1), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (0, 5)}


def test_deep_headers_and_many_spans():
    import base64

    automaton = secrets._automaton()
    deep = b'{"a":' + b"[" * 100_000
    token = b".".join([b"eyJ" + base64.urlsafe_b64encode(deep).rstrip(b"=")[3:], b"eyJhIjoxfQ", b"x"])
    assert secrets.scan(token, automaton) == []
    real = b".".join(base64.urlsafe_b64encode(json.dumps({"a": 1}, separators=(",", ":")).encode()).rstrip(b"=") for _ in range(2)) + b".sig"
    assert [secrets.KINDS[k] for _, k, _ in secrets.scan(real, automaton)] == ["jwt"]
    text = ("é " + "token=abcdef ") * 3
    spans = secrets._code_points(text.encode(), secrets.scan(text.encode(), automaton))
    assert [text[s["start"] : s["end"]] for s in spans] == ["token=abcdef"] * 3
