"""Manifests against a plain tree, recursion over blocks, and what tampering does to a root."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandwise.llm import merkle as mk


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """(root, path per node) by levels of whole lists."""
    paths = [[] for _ in nodes]
    where = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(where):
            run = at // 3 * 3
            paths[leaf].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        where = [at // 3 for at in where]
    return nodes[0], paths


def plain(rows):
    """Sorted (id, leaf, subroot, root, path) of rows (doc_id, source, text)."""
    groups = {}
    for i, source, text in rows:
        groups.setdefault(source, []).append((i is not None, i or 0, digest(*map(encoded, (i, source, text))), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: (sorted(groups[s]), *tree([r[2] for r in sorted(groups[s])])) for s in order}
    root, tops = tree([made[s][1] for s in order])
    return sorted(
        (str(r[3]), r[2], made[s][1], root, path + above)
        for s, above in zip(order, tops) for r, path in zip(made[s][0], made[s][2])
    )


def found(docs, **how):
    rows = mk.manifest(docs, ["doc_id", "source", "text"], **how).select("doc_id", "merkle.*").collect()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in rows)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_small_trees(spark, n):
    rows = [(n - i, None if i % 2 else "a", f"t{i}\n") for i in range(n)]
    assert found(table(spark, rows)) == plain(rows)


@pytest.mark.parametrize("height", [5, 1, 2])
def test_blocks_recurse(spark, monkeypatch, height):
    """One source holds most rows, more sources than a block holds."""
    monkeypatch.setattr(mk, "HEIGHT", height)
    monkeypatch.setattr(mk, "BLOCK", 3**height)
    n = 700 if height == 5 else 60
    rows = [(i * 7919 % 10007, "hot" if i % 2 else f"s{i % (600 if height == 5 else 30)}é", f"text {i}") for i in range(n)]
    rows += [(-1, "hot", "copy")] * 5
    assert found(table(spark, rows).repartition(7)) == plain(rows)


def test_joins_by_group_when_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(mk, "SENT_GROUPS", 0)
    rows = [(i, [None, "a", "b"][i % 3], "x") for i in range(50)]
    assert found(table(spark, rows)) == plain(rows)


def test_tampering_shows(spark):
    rows = [(i, f"s{i % 3}", f"line {i}\nmore") for i in range(40)]
    made = mk.manifest(table(spark, rows), ["doc_id", "source", "text"], keep=["doc_id", "source", "text"])
    now = F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text"))
    again = made.select("doc_id", (mk.folded(mk.leaf("doc_id", "source", now), F.col("merkle.path")) == F.col("merkle.root")).alias("ok"))
    assert [r.doc_id for r in again.where("NOT ok").collect()] == [7] and again.count() == 40
    proofs = {r.doc_id: r.p for r in made.select("doc_id", mk.proof_digest(F.col("merkle.path")).alias("p")).collect()}
    for i, _, _, _, path in plain(rows):
        assert proofs[int(i)] == digest(*(left + right for left, right in path))


def test_hostile_rows(spark, hostile, empty):
    rows = [(r.doc_id, r.source, r.text) for r in hostile.select("doc_id", "source", "text").collect()]
    assert found(hostile) == plain(rows)
    docs = hostile.withColumns({c: F.lit(i) for i, c in enumerate(["g", "b", "pos", "load", "digest", "place", "top", "up", "merkle", "r", "from", "id", "c0"])})
    docs = docs.withColumn("map", F.create_map(F.lit("k"), F.lit(1)))
    names = [c for c in docs.columns if c != "text"]
    got = mk.manifest(docs, ["doc_id", "source", "text"], keep=names)
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple(str(v) for v in r)
    kept = [c for c in names if c != "merkle"]
    assert sorted(got.select(kept).collect(), key=key) == sorted(docs.select(kept).collect(), key=key)
    assert found(empty) == []
