"""Ranked lexical search: one automaton of all item terms counts them while documents are scanned.

Every term is guarded by a space on either side and every text is rewritten so that one space or more stands
wherever a term ends. A hit of the automaton is then a whole term, and no document is split into words or
indexed. Texts are scanned twice: once for the document frequencies, once for the scores, of which each task keeps
the best per item. Only those rows move.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandwise.session import stage

TOP = 20
BLOCK_BYTES = 8 << 20  # item text per automaton; an item that is larger makes a block of its own
BLOCK_ROWS = 1 << 20  # best rows that a task holds for the items of a block
SCAN_BYTES = 2 << 20  # text scanned at a time
ROWS = 256  # rows whose texts are held as Python objects at a time
CELLS = 1 << 22  # scores (document, item) summed at a time
STEPS = 1 << 20  # summands made at a time

#: A-Z to a-z; every byte that ends a term to a space. Bytes from 0x80 belong to terms.
_TO_TERMS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, with repeats."""
    return [] if text is None else text.translate(_TO_TERMS).split()


class Items:
    """A block of items: its terms in order, and per term the items that hold it with their counts."""

    def __init__(self, ids: list, texts: list[bytes | None]):
        self.name, self.ids = uuid.uuid4().hex, ids
        holders: dict[bytes, list[tuple[int, int]]] = {}
        for i, text in enumerate(texts):
            for term, times in Counter(terms_of(text)).items():
                holders.setdefault(term, []).append((i, times))
        self.terms = sorted(holders)
        self.first = np.cumsum([0, *(len(holders[t]) for t in self.terms)])
        flat = [pair for t in self.terms for pair in holders[t]]
        self.item = np.array([i for i, _ in flat], dtype=np.int64)
        self.times = np.array([n for _, n in flat], dtype=np.int64)


_BUILT: dict[str, ahocorasick.Automaton] = {}  # the automaton of the block that this worker has last seen


def _automaton(items: Items) -> ahocorasick.Automaton:
    if items.name not in _BUILT:
        _BUILT.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(items.terms):
            made.add_word(f" {term.decode('latin-1')} ", i)
        made.make_automaton()
        _BUILT[items.name] = made
    return _BUILT[items.name]


def _pieces(text: bytes) -> Iterator[bytes]:
    """The guarded text, cut at spaces; neighbours share the space."""
    at, end = 0, len(text)
    while end - at > SCAN_BYTES and (cut := text.find(b" ", at + SCAN_BYTES)) < end - 1 and cut > 0:
        yield text[at : cut + 1]
        at = cut
    yield text[at:]


class _Scanner:
    """Counts an item block's terms in texts, a stretch of documents at a time."""

    def __init__(self, items: Items, most_rows: int):
        self.automaton, self.n_terms, self.most_rows = _automaton(items), len(items.terms), most_rows

    def stretches(self, batches: Iterable[pa.RecordBatch], text: str, key: str | None) -> Iterator[tuple]:
        """(ids, n, document, term, tf): per stretch the documents' ids and lengths, and its counts above 0."""
        ids, texts, size = [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                keys = part.column(key).to_pylist() if key else [None] * part.num_rows
                for k, t in zip(keys, part.column(text).cast(pa.large_binary()).to_pylist()):
                    ids.append(k)
                    texts.append(b" " + t.translate(_TO_TERMS) + b" " if t else b" ")
                    size += len(texts[-1])
                    if size >= SCAN_BYTES or len(ids) >= self.most_rows:
                        yield ids, *self._count(texts)
                        ids, texts, size = [], [], 0
        if ids:
            yield ids, *self._count(texts)

    def _count(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        n = np.empty(len(texts), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        run: list[bytes] = []
        starts: list[int] = []
        at, first = 0, 0

        def scan(shift: int) -> None:
            hits = np.fromiter(self.automaton.iter(b"".join(run).decode("latin-1")), dtype=[("end", "i8"), ("term", "i8")])
            document = np.searchsorted(np.array(starts), hits["end"], side="right") - 1 + shift
            found.append(np.unique(document * self.n_terms + hits["term"], return_counts=True))

        for i, t in enumerate(texts):
            inside = np.frombuffer(t, dtype=np.uint8) != 0x20
            n[i] = np.count_nonzero(inside[1:] & ~inside[:-1])
            if len(t) <= SCAN_BYTES:
                starts.append(at)
                run.append(t)
                at += len(t)
                continue
            if run:
                scan(first)
            for piece in _pieces(t):  # a long text by itself
                run, starts = [piece], [0]
                scan(i)
            run, starts, at, first = [], [], 0, i + 1
        if run:
            scan(first)
        if not found:
            return n, *(np.empty(0, dtype=np.int64) for _ in range(3))
        cells, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        tf = np.zeros(len(cells), dtype=np.int64)
        np.add.at(tf, where, np.concatenate([c for _, c in found]))
        return n, cells // self.n_terms, cells % self.n_terms, tf


class _Best:
    """The best rows of every item so far: highest scores first, equal ones by id, nulls first."""

    def __init__(self, items: Items, top: int):
        self.items, self.top = items, top
        self.item = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.int64)
        self.ids: list = []
        self.least = np.ones(len(items.ids), dtype=np.int64)  # a row below it cannot enter

    def add(self, ids: list, document: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Sums ``value`` times the items' counts over the terms of each document."""
        block, n_items = self.items, len(self.items.ids)
        scores = np.zeros(len(ids) * n_items, dtype=np.int64)
        holders = block.first[term + 1] - block.first[term]
        upto = np.cumsum(holders)
        at = 0
        while at < len(term):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEPS, side="right")))
            reps = holders[at:end]
            place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(block.first[term[at:end]], reps)
            cell = np.repeat(document[at:end] * n_items, reps) + block.item[place]
            np.add.at(scores, cell, np.repeat(value[at:end], reps) * block.times[place])
            at = end
        table = scores.reshape(len(ids), n_items)
        rows, items = np.nonzero(table >= self.least)
        if not len(rows):
            return
        used, back = np.unique(rows, return_inverse=True)
        names = self.ids + [ids[i] for i in used.tolist()]
        which = np.concatenate([np.arange(len(self.ids)), len(self.ids) + back])
        item, score = np.concatenate([self.item, items]), np.concatenate([self.score, table[rows, items]])
        place = {v: i for i, v in enumerate(sorted(set(names), key=lambda v: (v is not None, v)))}
        order = np.lexsort((np.array([place[v] for v in names])[which], -score, item))
        item, score, which = item[order], score[order], which[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        last = nth == self.top - 1
        self.least[item[last]] = score[last]
        kept = nth < self.top
        self.item, self.score = item[kept], score[kept]
        self.ids = [names[i] for i in which[kept].tolist()]


def _blocks(items: DataFrame, item_id: str, item_text: str, top: int, block_bytes: int) -> Iterator[Items]:
    """The items in blocks of bounded text; the driver holds one block at a time."""
    rows = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL")
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        more = row["text"].encode()
        if ids and (size + len(more) > block_bytes or len(ids) >= max(1, BLOCK_ROWS // top)):
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(more)
        size += len(more)
    if ids:
        yield Items(ids, texts)


def _statistics(docs: DataFrame, text: str, shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each of the block's terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        holding = np.zeros(len(block.terms), dtype=np.int64)
        documents = terms = 0
        for _, n, _, term, _ in _Scanner(block, 1 << 16).stretches(batches, text, None):
            documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
            holding += np.bincount(term, minlength=len(holding))
        seen = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *seen.tolist()], pa.int64()), pa.array([documents, *holding[seen].tolist()], pa.int64()), pa.array([terms, *[0] * len(seen)], pa.int64())],
            names=["term", "documents", "terms"],
        )

    parts = docs.mapInArrow(run, "term long, documents long, terms long")
    df = np.zeros(len(shared.value.terms), dtype=np.int64)
    documents = terms = 0
    for row in parts.groupBy("term").agg(F.sum("documents"), F.sum("terms")).toLocalIterator():  # a row per term of the block
        if row[0] < 0:
            documents, terms = row[1], row[2]
        else:
            df[row[0]] = row[1]
    return documents, terms, df


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item, all if fewer score above 0.

    A term is a run of letters, digits and all characters beyond ASCII, with A-Z lower-cased. Its weight follows
    its document frequency, its share of a score saturates with its count and falls with the document's length
    against the mean length.

    Null and empty texts hold no term: such documents are not counted and such items have no row. Equal scores
    go by ascending id, nulls first. Repeated documents are documents of their own, and so are repeated items,
    each with its own ranking. Ids may be of any type that sorts. No documents or no items give no rows. Other columns are
    not read, whatever their names.

    Items are read in blocks of ``block_bytes`` of text, each a scan of its own over all documents.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kinds = T.StructType([
        T.StructField("block", T.IntegerType()), T.StructField("item", T.LongType()),
        T.StructField("item_id", items.schema[item_id].dataType), T.StructField("doc_id", docs.schema[doc_id].dataType),
        T.StructField("score", T.LongType()),
    ])
    found = []
    for k, block in enumerate(_blocks(items, item_id, item_text, top, block_bytes)):
        if not block.terms:
            continue
        shared = spark.sparkContext.broadcast(block)
        documents, terms, df = _statistics(source.select("text"), "text", shared)
        weight = np.array([int(np.floor(1000 * np.log((2 * documents + 2) / (2 * d + 1)))) for d in df.tolist()], dtype=np.int64)
        best = source.mapInArrow(_ranker(shared, k, weight, documents, terms, top, kinds), kinds)
        found.append(best)
    if not found:
        return spark.createDataFrame([], kinds).select("item_id", F.lit(0).alias("rank"), "doc_id", "score")
    if len(found) > 1:
        found = [stage(b, "search") for b in found]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _ranker(shared, k: int, weight: np.ndarray, documents: int, terms: int, top: int, kinds: T.StructType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = _Best(block, top)
        scanner = _Scanner(block, max(1, CELLS // len(block.ids)))
        for ids, n, document, term, tf in scanner.stretches(batches, "text", "id"):
            if not len(term):
                continue
            length = np.array([75 + 25 * x * documents // terms for x in n.tolist()], dtype=np.int64)
            best.add(ids, document, term, weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * length[document])))
        columns = [[k] * len(best.ids), best.item.tolist(), [block.ids[i] for i in best.item.tolist()], best.ids, best.score.tolist()]
        if best.ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kinds)], names=kinds.names
            )

    return run
