"""Embedding near duplicates, the shingle join and components, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandwise.llm import embeddings, shingle_join
from strandwise.llm.components import components


def roots_by_force(nodes, links):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(links)
    edges = spark.createDataFrame(links, "a long, b long")
    ends = {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.root for r in components(edges).collect()}
    want = roots_by_force(ends, links)
    assert got == {n: min(m for m in want if want[m] == want[n]) for n in ends}
    assert components(edges.where("false")).count() == 0


def test_embeddings_by_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((25, 32))
    rows = []
    for i in range(240):
        v = centres[i % 25] + rng.standard_normal(32) * rng.choice([0.1, 0.25, 0.33])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], None), (303, None, 0), (304, [0.0] * 32, 0), (305, [float("nan")] * 32, 0)]
    rows += [(306, [None] + [1.0] * 31, 0), (307, [float("inf")] * 32, 0), (308, [], 0), (309, rows[0][1][:8], 0), (310, [x * 1e30 for x in rows[0][1]], 0), (311, [-x for x in rows[0][1]], 0)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, cls string")
    for tile in (1024, 8):
        got = {r.id: (r.n_links, r.component, r.kept) for r in embeddings.near_duplicates(frame, tile=tile).collect()}
        good = [(i, np.array(v, float), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
        links = [(a, b) for a, x, k in good for b, y, m in good if a < b and k == m and len(x) == len(y) and x / np.linalg.norm(x) @ (y / np.linalg.norm(y)) >= 0.93]
        root = roots_by_force([r[0] for r in rows], links)
        count = {r[0]: sum(r[0] in p for p in links) for r in rows}
        assert len(links) > 50
        assert got == {i: (count[i], root[i], root[i] == i) for i in root}
    assert embeddings.near_duplicates(frame.where("false")).count() == 0


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((2, 64))
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    estimates, inside = [], 0
    for k in range(400):
        turned, other = x @ embeddings.rotation(64, k), y @ embeddings.rotation(64, k)
        factor = np.abs(turned).sum() / 8
        e = np.where(turned > 0, 1, -1) @ other / 8 / factor
        estimates.append(e)
        inside += abs(e - x @ y) <= embeddings.DEVIATIONS * np.sqrt(1 - factor**2) / factor / np.sqrt(63)
    assert abs(np.mean(estimates) - x @ y) < 0.02 and inside == 400


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def join_rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, line = [], [rng.choice(vocabulary) for _ in range(30)]
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 90))]
        if g % 3 == 0:
            base += line
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text) if rng.random() < 0.5 else "  ".join(text).upper())
            base = text if rng.random() < 0.5 else base  # copies of copies
    rows += ["a b c", "A  B c", "a b c d", "", "  ", None, None, rows[0], rows[0]]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i - 3, t) for i, t in zip(ids, rows)] + [(None, rows[5]), (None, "alone with a null id in here")]


def test_join_by_force(spark, hostile, empty):
    rows = join_rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, cls string")
    got = {(r.id, r.n_shingles, r.component) for r in shingle_join.near_duplicates(frame).collect()}
    known = [(k, r[0], shingles(r[1])) for k, r in enumerate(rows)]
    links = [(a, b) for a, _, x in known for b, _, y in known if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    root = roots_by_force(range(len(rows)), links)
    smallest = {}
    for k, i, _ in known:
        if i is not None:
            smallest[root[k]] = min(i, smallest.get(root[k], i))
    assert len(links) > 40
    assert got == {(i, len(s), smallest.get(root[k], i)) for k, i, s in known}
    kept = shingle_join.keep_one(frame)
    assert kept.columns == frame.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == sorted([i for i in set(smallest.values()) if any(j == i and s for _, j, s in known)] + [i for _, i, s in known if i is not None and not s])
    assert shingle_join.near_duplicates(hostile).count() == hostile.count()
    assert shingle_join.keep_one(hostile).columns == hostile.columns
    assert shingle_join.near_duplicates(empty).count() == 0 and shingle_join.keep_one(empty).count() == 0


def test_prefix_filter_bound():
    """Linked sets share enough prefix shingles, whatever the order."""
    rng = random.Random(2)
    for _ in range(200):
        n, order = rng.randrange(1, 60), list(range(200))
        rng.shuffle(order)
        x = set(rng.sample(range(200), n))
        y = set(x)
        for _ in range(rng.randrange(0, max(1, n // 4))):
            y.discard(rng.choice(sorted(y) or [0]))
        y |= set(rng.sample(range(200), rng.randrange(0, 4)))
        if not y or 100 * len(x & y) < 75 * len(x | y):
            continue
        head = lambda s: set(sorted(s, key=order.index)[: shingle_join.prefix_size(len(s))])
        needed = -(-(len(x) + len(y)) * 75 // 175)
        least = max(1, needed - max(shingle_join.least_part(len(x)), shingle_join.least_part(len(y))) + 1)
        assert len(head(x) & head(y)) >= least


def test_word_hashes(monkeypatch):
    text = b"One two\t\nTHREE  \x0b four\x0cone \xc3\xa9 two"
    got = shingle_join.word_hashes(text).tolist()
    assert got == [int(shingle_join.word_hashes(w)[0]) for w in text.split()]
    assert len(set(got)) == 5 and shingle_join.word_hashes(b" \n").tolist() == []
    monkeypatch.setattr(shingle_join, "CHUNK", 4)
    assert shingle_join.word_hashes(text).tolist() == got


def test_counts_per_range_bound_the_intersection():
    """No linked pair is told apart by its counts; the bound holds for any pair."""
    import numpy as np

    from strandwise.llm import shingle_join as sj

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40, 3000):
        for share in (0.0, 0.5, 0.85, 1.0):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            y = np.unique(np.concatenate([x[: int(len(x) * share)], rng.integers(0, 1 << 63, n - int(len(x) * share), dtype=np.uint64)]))
            a, b = sj._counts_of(sj._ranges(x)), sj._counts_of(sj._ranges(y))
            assert a.sum() == len(x) and b.sum() == len(y)
            assert np.minimum(a, b).sum() >= len(np.intersect1d(x, y))
    many = np.full(70_000, 5, dtype=np.uint64)  # more in a range than two bytes hold
    assert sj._ranges(np.empty(0, dtype=np.uint64)) is None and sj._counts_of(sj._ranges(many))[0] == 70_000


def test_counts_of_sets_of_different_size():
    """Larger sets have more ranges; a pair of different numbers of ranges is compared on the fewer, and no link is lost."""
    import numpy as np

    from strandwise.llm import shingle_join as sj

    rng = np.random.default_rng(4)
    told = 0
    for n in (300, 510, 515, 1030, 6000, 70_000):
        whole = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        for kept in (0.75, 0.8, 1.0):
            part = whole[np.sort(rng.permutation(len(whole))[: int(np.ceil(len(whole) * kept))])]
            assert sj.may_link((sj._ranges(whole), sj._ranges(part))) and sj.may_link((sj._ranges(part), sj._ranges(whole)))
        other = np.unique(np.concatenate([whole[: n // 3], rng.integers(0, 1 << 64, n - n // 3, dtype=np.uint64)]))
        told += not sj.may_link((sj._ranges(whole), sj._ranges(other)))
    assert told == 6  # a third in common is seen as too little at every size
    copies = np.full(300, 5, dtype=np.uint64)
    assert sj._counts_of(sj._ranges(copies))[0] == 300 and len(sj._ranges(np.arange(3, dtype=np.uint64))) == 1 + sj.RANGES
