import hashlib
import random

from strandwise.llm.substrings import LENGTH, repeated_spans


def by_force(rows):
    """Remove bytes of every 50-byte string that starts in a row with a smaller id."""
    last = (1 << 63) - 1
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - LENGTH + 1):
            w = b[p : p + LENGTH]
            first[w] = min(first.get(w, last), last if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - LENGTH + 1):
            if first[b[p : p + LENGTH]] < (last if i is None else i):
                gone[p : p + LENGTH] = [True] * LENGTH
        spans = sum(g and not h for g, h in zip(gone, [False, *gone]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, doc int, marks string")
    got = repeated_spans(docs, keep=["doc_id"]).select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(by_force(rows), key=key)


def test_passages_copies_and_edges(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (45, 50, 51, 60, 90, 200)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 80))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts += [p[cut:] if rng.random() < 0.3 else p, text(rng.randrange(0, 30))]
        rows.append((rng.randrange(50) - 5, "".join(parts)))
    rows += [(None, passages[5]), (None, passages[5] + "z"), (70, None), (71, ""), (72, "ab" * 400), (73, "b" + "ab" * 90), (74, "a" * 49), (75, "a" * 300), (76, "a" * 51)]
    rows += [(80, rows[3][1]), (80, rows[3][1]), (81, rows[3][1][:-7] + "Q")]
    check(spark, rows)


def test_long_text_over_chunks(spark, monkeypatch):
    from strandwise.llm import substrings

    rng = random.Random(5)
    body = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    monkeypatch.setattr(substrings, "CHUNK", 256)
    runs = substrings.Runs(body.encode())
    monkeypatch.undo()
    whole = substrings.Runs(body.encode())
    assert runs.windows.tolist() == whole.windows.tolist()


def test_empty_table(spark):
    assert repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_named_together_are_named_alike():
    from strandwise.llm import substrings

    rng = random.Random(7)
    texts = ["".join(rng.choice("abc ") for _ in range(n)).encode() for n in (0, 300, 49, 50, 0, 51, 700, 3)]
    together = substrings.Runs(*texts)
    for k, text in enumerate(texts):
        alone, own, at = substrings.Runs(text), slice(together.cut[k], together.cut[k + 1]), together.start[k]
        assert together.anchor[own].tolist() == alone.anchor.tolist() and together.context[own].tolist() == alone.context.tolist()
        assert (together.first[own] - at).tolist() == alone.first.tolist() and (together.last[own] - at).tolist() == alone.last.tolist()


def test_only_windows_of_a_shared_side_are_looked_at():
    import numpy as np

    from strandwise.llm import substrings

    text = bytes(random.Random(9).choices(b"abcdefgh ", k=400))
    runs = substrings.Runs(text)
    n = len(runs.first)

    def windows(left, right):
        mark = {"context": runs.context.view(np.int64), "name": runs.anchor.view(np.int64), "open": np.ones(n, bool), "left": np.full(n, left), "right": np.full(n, right)}
        return sum(len(part[1]) for part in substrings._edge_windows([([1], [text], [mark])]))

    middle = runs.chosen - substrings.REACH
    both = int(((runs.first <= middle) & (middle <= runs.last)).sum())
    assert windows(True, True) == len(text) - LENGTH + 1
    assert windows(True, False) + windows(False, True) == windows(True, True) + both
    assert 0 < windows(True, False) < windows(True, True)
