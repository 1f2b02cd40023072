"""Benchmark decontamination: n-gram windows of test items looked up while scanning documents.

The set of normalised test windows is broadcast with the task in blocks of bounded size; a benchmark
beyond one block is scanned block by block, with a written table between. Documents never move.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandwise.llm.columns import fresh, with_struct
from strandwise.session import stage

WINDOW = 13
BLOCK_BYTES = 16 << 20  # benchmark text per broadcast block

#: A-Z to a-z; every byte outside words to a space. Bytes from 0x80 belong to words.
_TO_WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return [] if text is None else text.translate(_TO_WORDS).split()


class _Windows:
    """The windows of a block of items: a vocabulary, and per window length a hash set to exact windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.by_length: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)], dtype=np.int32)
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                self.by_length.setdefault(n, {}).setdefault(ids[i : i + n].tobytes(), set()).add(item)
        rng = np.random.default_rng(1)
        self.factors = rng.integers(1, 2**63, size=window, dtype=np.uint64) | np.uint64(1)
        self.hashes = {
            n: np.unique(self._hash(np.frombuffer(b"".join(at), dtype=np.int32).reshape(-1, n)))
            for n, at in self.by_length.items()
        }

    def _hash(self, windows: np.ndarray) -> np.ndarray:
        return (windows.astype(np.uint64) * self.factors[: windows.shape[1]]).sum(axis=1, dtype=np.uint64)

    def scan(self, words: list[bytes]) -> tuple[set[str], list[list[int]]]:
        """Items with an occurring window, and the runs [start, end) of covered words."""
        get, n = self.vocab.get, len(words)
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=n)
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        found: set[str] = set()
        step = np.zeros(n + 1, dtype=np.int32)
        for length, exact in self.by_length.items():
            if n < length:
                continue
            starts = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(starts):
                continue
            got = np.zeros(len(starts), dtype=np.uint64)
            for k in range(length):
                got += ids[starts + k].astype(np.uint64) * self.factors[k]
            for i in starts[np.isin(got, self.hashes[length])].tolist():
                if items := exact.get(ids[i : i + length].tobytes()):
                    found |= items
                    step[i] += 1
                    step[i + length] -= 1
        if not found:
            return found, []
        covered = np.concatenate([[0], (np.cumsum(step[:-1]) > 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(covered))
        return found, edges.reshape(-1, 2).tolist()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "contamination",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with the struct ``out``: ``n_words``, ``items`` (ids with an occurring window), ``spans``.

    A window is ``window`` consecutive words of an item; a shorter item is one window, an item without
    words none. ``spans`` are the runs [start, end) of word numbers that lie inside an occurrence.

    Null texts have no words. Null item ids are called "null"; items that share an id count once. An
    empty benchmark finds nothing. A column already called ``out`` is replaced; other columns stay.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    block = F.pmod(F.xxhash64("id", "t"), F.lit(blocks))
    result, columns = docs, keep
    for k in range(blocks):
        # at most about block_bytes of text: the bound was checked by the sum above
        part = [(r.id, r.t.encode()) for r in items.where(block == k).collect()]
        prior = fresh(f"_{out}_before", docs.columns) if k else None
        if prior:
            result = stage(result.withColumnRenamed(out, prior), "contamination")
        names = [c for c in (docs.columns if columns is None else columns) if c != out]
        carried = names + ([prior] if prior else []) + ([text] if k + 1 < blocks and text not in names else [])
        result = with_struct(result, text, out, FIELDS, _finder(part, window), keep=carried)
        if prior:
            result = result.withColumn(out, _merged(F.col(prior), F.col(out))).drop(prior)
    return result if blocks == 1 else result.select(*names, out)


def _finder(part: list[tuple[str, bytes]], window: int):
    def make():
        windows = _Windows(part, window)

        def fn(texts: list[bytes | None]) -> list[dict]:
            rows = []
            for t in texts:
                words = words_of(t)
                items, spans = windows.scan(words)
                rows.append({"n_words": len(words), "items": sorted(items), "spans": spans})
            return rows

        return fn

    return make


def _merged(a: Column, b: Column) -> Column:
    """Both blocks' findings; spans of different blocks may overlap until they are counted."""
    return F.struct(
        a["n_words"].alias("n_words"), F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
        F.concat(a["spans"], b["spans"]).alias("spans"),
    )


def hit_words(found: Column) -> Column:
    """Number of words inside the spans, each counted once."""
    ordered = F.array_sort(found["spans"])
    total = F.aggregate(
        ordered, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x[1] - F.greatest(x[0], s["end"]))).alias("n"),
            F.greatest(s["end"], x[1]).alias("end"),
        ),
    )
    return total["n"].cast("long")


def is_contaminated(found: Column) -> Column:
    """Are at least a twentieth of the words inside benchmark windows?"""
    hit = hit_words(found)
    return (hit > 0) & (hit * 20 >= found["n_words"])


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, columns unchanged whatever their names. Null and empty texts stay."""
    out = fresh("contamination", docs.columns)
    found = find_contamination(docs, benchmark, text, out=out)
    return found.where(~is_contaminated(F.col(out))).drop(out)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` whose texts have lost the words inside benchmark windows, and what stood between those.

    Null and empty texts stay as they are, and so do all other columns, whatever their names.
    """
    out = fresh("contamination", docs.columns)
    found = find_contamination(docs, benchmark, text, out=out, window=window)
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, hits = batch.column(text).cast(pa.binary()).to_pylist(), batch.column(out).to_pylist()
            cut = pa.array([_without(t, h["spans"]) for t, h in zip(texts, hits)], type=pa.binary()).cast(pa.string())
            columns = [cut if i == at else batch.column(c) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.select(*[f"`{c}`" for c in names], out).mapInArrow(run, schema)


def _without(text: bytes | None, spans: list[list[int]]) -> bytes | None:
    if not text or not spans:
        return text
    mask = np.frombuffer(text.translate(_TO_WORDS), dtype=np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in sorted(spans):
        if first[a] > at:
            out.append(text[at : first[a]])
        at = max(at, int(last[b - 1]))
    return b"".join([*out, text[at:]])


def items_digest(items: list[str]) -> str:
    """Lowercase hex sha256 of the sorted ids, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
