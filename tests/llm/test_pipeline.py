"""The pipeline's stages on the smallest tables against plain versions of each."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np

import corpus_pipeline as P
from strandwise.llm import token_records
from strandwise.llm.sql import OP9_SQL
from strandwise.session import stage
from tests.llm.test_pairs import roots_by_force, shingles
from tests.llm.test_text_operators import decontamination_by_force
from strandwise.llm import queries

SF = "/root/testdata/sf0.001"


def test_each_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_records"]

    kept = stage(steps["toxicity"](spark, docs, SF), "t")
    clean = {r.doc_id for r in queries.op1_toxicity(spark, SF).where("predicted = 0").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == clean

    rows = kept.select("doc_id", "text").collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    links = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    single = stage(steps["near_duplicates"](spark, kept, SF), "t")
    root = roots_by_force(sets, links)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(d for d in sets if root[d] == d)

    rows = single.select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = decontamination_by_force([(r.doc_id, r.text) for r in rows], items)
    pure = stage(steps["decontamination"](spark, single, SF), "t")
    assert pure.columns == columns
    assert sorted(r.doc_id for r in pure.collect()) == sorted(d for d, (n, hit, _) in found.items() if not (hit and 20 * hit >= n))

    pure.coalesce(1).write.parquet(str(tmp_path / "pure"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/pure/*.parquet'")
    taken = {r[0]: r[4] for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({OP9_SQL}) m").fetchall()}
    mix = stage(steps["mixing"](spark, pure, SF), "t")
    assert mix.columns == columns
    words = defaultdict(int)
    for r in mix.collect():
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {d: n for d, n in taken.items() if n}

    out = steps["token_records"](spark, mix, SF).orderBy("start").collect()
    encode = token_records.Encoder(token_records.default_vocabulary())
    want = Counter()
    for r in mix.collect():
        ids = np.frombuffer(encode([r.text])[0], "<u2").astype("<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    assert [r.start for r in out] == np.concatenate([[0], np.cumsum([r.n_tokens for r in out])])[:-1].tolist()
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out)


def test_hostile_documents(spark, hostile):
    docs = hostile.select("doc_id", "text", "source", "label")
    for name, step in P.STAGES:
        docs = stage(step(spark, docs, SF), f"hostile-{name}")
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, step in P.STAGES:
        docs = stage(step(spark, docs, SF), f"empty-{name}")
    assert docs.count() == 0
