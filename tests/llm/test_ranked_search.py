"""Ranked search against a plain version: whole-table statistics, every score, full sort."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwise.llm import ranked_search as rs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=20):
    """Rows (item, rank, doc, score) of docs and items given as (id, text)."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    n_terms = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    rows = []
    for item, text in items:
        scored = []
        for d, c in counts:
            score = 0
            for t in terms(text):
                if t in c:
                    m = 75 + 25 * c.total() * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is not None, d))
        rows += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return rows


def found(docs, items, **how):
    return [tuple(r) for r in rs.search(docs, items, **how).collect()]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["a", "b", "aa", "ab", "Ba", "élan", "日本", "x1", "1", "A-b", "a_b", "naïve"] + [f"w{i}" for i in range(40)]
    docs = [(i, rng.choice([" ", "\n", ", ", "--"]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(120)]  # a large group of copies: equal scores
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 15)))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"block_bytes": 1}, {"block_bytes": 200, "top": 3}, {"top": 500}])
def test_against_plain_version(spark, corpus, how):
    docs, items = corpus
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), **how)
    assert sorted(got) == sorted(plain(docs, items, how.get("top", 20)))


def test_small_stretches(spark, corpus, monkeypatch):
    """Pieces, stretches and sums of any size give the same counts."""
    docs, items = corpus
    block = rs.Items([i for i, _ in items], [t.encode() for _, t in items])
    want = {(d, block.terms[k], n) for d, k, n in _counts(rs._Scanner(block, 1000), docs)}
    monkeypatch.setattr(rs, "SCAN_BYTES", 40)
    monkeypatch.setattr(rs, "STEPS", 3)
    for most in (1, 7, 1000):
        assert {(d, block.terms[k], n) for d, k, n in _counts(rs._Scanner(block, most), docs)} == want
    plainly = {(d, t.encode(), n) for d, text in docs for t, n in Counter(terms(text)).items()}
    held = set(block.terms)
    assert want == {x for x in plainly if x[1] in held}


def _counts(scanner, docs):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [d for d, _ in docs], "text": [t for _, t in docs]})
    for ids, n, document, term, tf in scanner.stretches([batch], "text", "id"):
        assert len(ids) == len(n)
        yield from ((ids[d], k, c) for d, k, c in zip(document.tolist(), term.tolist(), tf.tolist()))


def test_hostile_rows(spark, hostile, empty):
    items = spark.createDataFrame(
        [(1, "plain WORDS word", "x"), (1, "one", "x"), (None, "ünïcödé no id", "x"), (2, None, "x"), (3, "", "x"), (4, "?!", "x"), (5, "absent9", "x")],
        "item_id long, text string, score string",
    )
    docs = [(r.doc_id, r.text) for r in hostile.select("doc_id", "text").collect()]
    want = plain(docs, [(r.item_id, r.text) for r in items.collect()])
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(found(hostile, items), key=key) == sorted(want, key=key)
    assert rs.search(empty, items).count() == 0 and rs.search(hostile, items.where("false")).count() == 0
    assert rs.search(hostile, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "key string, body string")
    items = spark.createDataFrame([("q", "x")], "name string, body string")
    got = rs.search(docs, items, 2, "key", "body", "name", "body").orderBy("rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [("q", 1, None), ("q", 2, "a")]


def test_only_best_rows_move(spark, corpus):
    docs, items = corpus
    df = rs.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Join" not in plan
    assert df.agg(F.max("rank")).first()[0] <= 20
