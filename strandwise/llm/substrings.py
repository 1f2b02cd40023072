"""Removal of byte strings of 50 and more that an earlier document has, by anchor fingerprints.

This takes the place of prefix doubling: no position is given a rank and none is ranked again at growing
offsets. Only some positions are compared, chosen by content: in each window of 50 bytes the 24-byte string with the smallest
hash is the window's anchor. Equal windows have equal anchors at equal places, so nothing is missed, and
about one position in fourteen is an anchor.

Names are 64-bit hashes made inside each row: a string of twice the length is named by the pair of names
at its position and half a length on. Up to 8 bytes the bytes are the name, then pairs are hashed. Spark
groups equal names at fixed lengths and drops what has become unique:

1. 24 bytes at the anchors; strings within one document only drop out.
2. The run of windows around an anchor, named by the pair of its first and last window. A run that an
   earlier document has too goes whole; runs whose anchor no earlier document has are done.
3. 37 bytes, 13 more to the left or to the right of the anchor. Every window reaches that far on one side, so a
   run that shares neither with an earlier document is done.
4. The 50-byte windows of the runs that are left, at the edges of matches, one by one: those that hold a shared side.

Names of one anchor are compared only among themselves, 128 bits in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandwise.llm.columns import fresh
from strandwise.llm.filters import with_flag
from strandwise.session import stage

LENGTH = 50
ANCHOR = 24
WINDOWS = LENGTH - ANCHOR + 1  # anchors to choose from in a window
REACH = (LENGTH - ANCHOR) // 2  # bytes beside the anchor that each window has on one side at least
CHUNK = 1 << 20  # bytes of a text that are named at a time
BLOCK = 1 << 15  # bytes of texts that are named together
TABLE = 1 << 14
ROWS = 64
LAST = (1 << 63) - 1  # stands for a null id

_PLACE = np.uint64((1 << 24) - 1)
RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


# --- names ---------------------------------------------------------------------------------------


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each pair of names."""
    h = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _short_names(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 16 and the 24 bytes from each position on, doubled from 1, 2, 4 and 8."""
    name = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    for half in (1, 2, 4):
        name = name[: len(name) - half] | (name[half:] << np.uint64(8 * half))
    by16 = _pair(name[:-8], name[8:])
    return by16, _pair(by16[: len(by16) - 8], name[16:])


def _anchor_places(by24: np.ndarray) -> np.ndarray:
    """For each window the place of its smallest hash, kept in the low bits meanwhile; of equal ones the first."""
    low = (by24 & ~_PLACE) | np.arange(len(by24), dtype=np.uint64)
    span = 1
    while span * 2 <= WINDOWS:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < WINDOWS:
        low = np.minimum(low[: len(low) - (WINDOWS - span)], low[WINDOWS - span :])
    return (low & _PLACE).astype(np.int64)


class Runs:
    """Of a text, or of several that are looked at together: the runs of windows that share an anchor, and
    names of strings, made where they are asked for.

    ``anchor`` names the 24 bytes at a run's anchor, which starts at ``chosen``; ``first`` and ``last`` are the
    starts of the run's first and last window, all as places in the joined texts. Text k begins at ``start[k]`` and has the
    runs from ``cut[k]`` up to ``cut[k + 1]``; no run holds windows of two texts.
    """

    def __init__(self, *texts: bytes):
        text = texts[0] if len(texts) == 1 else b"".join(texts)
        n = len(text)
        self.start = np.cumsum([0, *map(len, texts)])
        parts = [self._chunk(text[at : at + CHUNK + LENGTH - 1], at) for at in range(0, n - LENGTH + 1, CHUNK)]
        join = lambda k, kind: parts[0][k] if len(parts) == 1 else np.concatenate([p[k] for p in parts]) if parts else np.empty(0, dtype=kind)
        self.anchor = join(0, np.uint64)
        self.first, self.last, self.chosen = join(1, np.int64), join(2, np.int64), join(3, np.int64)
        for p in parts[:-1]:
            p[4] = p[4][:CHUNK]  # the rest is at the start of the next part
        self.by16 = join(4, np.uint64)
        self.cut = np.searchsorted(self.first, self.start)

    def _chunk(self, text: bytes, at: int) -> list[np.ndarray]:
        by16, by24 = _short_names(text)
        place = _anchor_places(by24)
        begin, end = np.ones(len(place), dtype=bool), np.ones(len(place), dtype=bool)
        np.not_equal(place[1:], place[:-1], out=begin[1:])
        end[:-1] = begin[1:]
        if len(self.start) > 2:
            alone = np.ones(len(place), dtype=bool)  # windows inside one text
            for border in (self.start[1:-1] - at).tolist():
                alone[max(0, border - LENGTH + 1) : max(0, border)] = False
            begin[1:] |= ~alone[:-1]
            end[:-1] |= ~alone[1:]
            begin &= alone
            end &= alone
        first, last = np.flatnonzero(begin), np.flatnonzero(end)
        chosen = place[first]
        return [by24[chosen], first + at, last + at, chosen + at, by16]

    def _by32(self, at: np.ndarray) -> np.ndarray:
        return _pair(self.by16[at], self.by16[at + 16])

    def windows_at(self, at: np.ndarray) -> np.ndarray:
        """Names of the windows that start at these places."""
        return _pair(self._by32(at), self._by32(at + (LENGTH - 32)))

    @cached_property
    def windows(self) -> np.ndarray:
        """The name of each 50-byte string of the joined texts."""
        by32 = _pair(self.by16[:-16], self.by16[16:])
        return _pair(by32[: max(0, len(by32) - (LENGTH - 32))], by32[LENGTH - 32 :])

    @cached_property
    def context(self) -> np.ndarray:
        """Names of all the bytes of each run's windows and of where in them the anchor lies."""
        shape = ((self.chosen - self.first) * 64 + (self.last - self.first)).astype(np.uint64)
        ends = self.windows_at(np.concatenate([self.first, self.last]))
        return _pair(_pair(ends[: len(shape)], ends[len(shape) :]), shape)

    def beside(self) -> tuple[np.ndarray, ...]:
        """Names of each anchor with the bytes to its left and to its right, 0 where no window of the run reaches that far; which do."""
        middle = self.chosen - REACH
        sides = (self.first <= middle, middle), (self.last >= middle, self.chosen)
        names = []
        for has, at in sides:
            name = np.zeros(len(has), dtype=np.uint64)
            name[has] = _pair(self._by32(at[has]), self._by32(at[has] + (ANCHOR + REACH - 32)))
            names.append(name)
        return names[0], names[1], sides[0][0], sides[1][0]


# --- passes --------------------------------------------------------------------------------------


def _over(texts: DataFrame, columns: list[str], fn: Callable, schema: str) -> DataFrame:
    """``fn(rows)`` over each task's rows as tuples of ``columns``; it yields lists of numpy arrays."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    yield [_READ.get(c, pa.Array.to_pylist)(part.column(c)) for c in columns]

        for out in fn(rows()):
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in out], names=names)

    return texts.select(*columns).mapInArrow(run, schema)


def _marks(column: pa.ListArray) -> list[dict[str, np.ndarray]]:
    """The fields of each row's list of structs as arrays."""
    ends = column.offsets.to_numpy()
    fields = column.values
    arrays = {f.name: fields.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(fields.type)}
    return [{k: v[a:b] for k, v in arrays.items()} for a, b in zip(ends[:-1], ends[1:])]


def _numbers(column: pa.ListArray) -> list[np.ndarray]:
    """Each row's list of numbers as an array, empty for null."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


_READ = {"text": lambda c: c.cast(pa.binary()).to_pylist(), "marks": _marks}


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``wanted`` that ``keys`` holds, and where in ``keys``."""
    order = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)
    hit = np.flatnonzero(keys[order[at]] == wanted)
    return hit, order[at[hit]]


def _among(wanted: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are in ``keys``; few pass a table of the keys' low bits."""
    table = np.zeros(TABLE, dtype=bool)
    table[keys & (TABLE - 1)] = True
    found = table[wanted & (TABLE - 1)]
    at = np.flatnonzero(found)
    found[at] = np.isin(wanted[at], keys)
    return found


def _anchors(rows) -> Iterator[list[np.ndarray]]:
    for group in rows:
        names, owners = [], []
        for docs, texts in _blocks(*group):
            runs = Runs(*[t or b"" for t in texts])
            for k, doc in enumerate(docs):
                names.append(np.unique(runs.anchor[runs.cut[k] : runs.cut[k + 1]]))
                owners.append(np.full(len(names[-1]), doc, dtype=np.int64))
        if names:
            yield [_signed(np.concatenate(names)), np.concatenate(owners)]


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, doc) in order: those of names that several documents have, with the first document.

    Between batches only the first document of the last name is kept, and whether its row has gone out.
    """
    held: tuple[int, int, bool] | None = None  # name, first document, written
    for batch in batches:
        name, doc = batch.column("name").to_numpy(), batch.column("doc").to_numpy()
        if not len(name):
            continue
        start = np.concatenate([[True], name[1:] != name[:-1]])
        if held and held[0] == name[0]:
            start[0] = False
            name, doc, start = np.concatenate([[held[0]], name]), np.concatenate([[held[1]], doc]), np.concatenate([[True], start])
            written = held[2]
        else:
            written = False
        place = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        first = doc[place][run]
        end = np.concatenate([place[1:], [len(name)]]) - 1
        several = (doc[end] != doc[place])[run]
        out = several.copy()
        if written:
            out[0] = False
        last = place[-1]
        held = (int(name[last]), int(doc[last]), bool(several[last]))
        # a row whose document repeats the first one is the first row itself: names are distinct within a document
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (name, doc, first)], names=["name", "doc", "first"])


def _blocks(*columns: list) -> Iterator[tuple[list, ...]]:
    """Rows in groups of about ``BLOCK`` bytes of text, which is the second column."""
    held, size = [], 0
    for row in zip(*columns):
        held.append(row)
        size += len(row[1] or b"")
        if size >= BLOCK:
            yield tuple(zip(*held))
            held, size = [], 0
    if held:
        yield tuple(zip(*held))


def _contexts(rows) -> Iterator[list]:
    for group in rows:
        out = []
        for docs, texts, marks in _blocks(*group):
            runs = Runs(*[t or b"" for t in texts])
            sides = runs.beside()
            for k, (doc, mark) in enumerate(zip(docs, marks)):
                hit, place = _found(mark["name"], _signed(runs.anchor[runs.cut[k] : runs.cut[k + 1]]))
                hit += runs.cut[k]
                context, once = np.unique(runs.context[hit], return_index=True)
                hit, place = hit[once], place[once]
                left, right, has_left, has_right = (side[hit] for side in sides)
                out.append([
                    _signed(runs.anchor[hit]), _signed(context), np.full(len(hit), doc, dtype=np.int64), mark["first"][place],
                    _signed(left), has_left, _signed(right), has_right,
                ])
        if out:
            name, context, doc, first, left, has_left, right, has_right = (np.concatenate(c) for c in zip(*out))
            yield [name, context, doc, first, pa.array(left, mask=~has_left), pa.array(right, mask=~has_right)]


def _edge_windows(rows) -> Iterator[list[np.ndarray]]:
    for group in rows:
        out = []
        for docs, texts, marks in _blocks(*group):
            runs = Runs(*[t or b"" for t in texts])
            for k, (doc, mark) in enumerate(zip(docs, marks)):
                hit, place = _found(mark["context"], _signed(runs.context[runs.cut[k] : runs.cut[k + 1]]))
                hit += runs.cut[k]
                same = mark["name"][place] == _signed(runs.anchor[hit])
                _, once = np.unique(runs.context[hit[same]], return_index=True)
                hit, place = hit[same][once], place[same][once]
                # the windows that hold the left side come first, the one at the middle holds both
                middle = runs.chosen[hit] - REACH
                first = np.where(mark["left"][place], runs.first[hit], np.maximum(runs.first[hit], middle))
                last = np.where(mark["right"][place], runs.last[hit], np.minimum(runs.last[hit], middle))
                size = np.maximum(0, last - first + 1)
                at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                out.append([
                    np.repeat(_signed(runs.anchor[hit]), size), _signed(runs.windows_at(at)), np.full(len(at), doc, dtype=np.int64),
                    np.repeat(mark["open"][place], size),
                ])
        if out:
            yield [np.concatenate(c) for c in zip(*out)]


def removed_spans(runs: Runs, k: int, whole: np.ndarray, single: np.ndarray) -> list[list[int]]:
    """Of text k: maximal runs of bytes inside windows of the ``whole`` contexts or with a name in ``single``."""
    begin, end, own = int(runs.start[k]), int(runs.start[k + 1]), slice(runs.cut[k], runs.cut[k + 1])
    n = end - begin - LENGTH + 1
    if n < 1 or not len(whole) + len(single):
        return []
    gone = np.zeros(n + 1, dtype=np.int32)
    hit = np.flatnonzero(_among(_signed(runs.context[own]), whole))
    np.add.at(gone, runs.first[own][hit] - begin, 1)
    np.add.at(gone, runs.last[own][hit] + (1 - begin), -1)
    start = np.cumsum(gone[:-1]) > 0
    if len(single):
        start |= _among(_signed(runs.windows[begin : begin + n]), single)
    at = np.flatnonzero(start)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > LENGTH)  # adjoining spans are one
    return np.stack([at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + LENGTH], axis=1).tolist()


# --- the operator --------------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "repeats", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the struct ``out``: ``n_bytes, n_removed, n_spans, kept_sha256, spans``.

    A byte goes when a 50-byte string over it also starts in a row with a smaller id. Null ids come last and
    are smaller than none; rows of equal ids do not count against each other. Null and empty texts, and texts
    of under 50 bytes, lose nothing. ``spans`` are byte offsets [start, end). Whole texts are judged as they
    came. A column already called ``out`` is replaced; other columns stay.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    doc = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST))
    texts = docs.select(doc.alias("doc"), F.col(f"`{text}`").alias("text"))
    anchors = _over(texts, ["doc", "text"], _anchors, "name long, doc long")
    ordered = anchors.repartition("name").sortWithinPartitions("name", "doc")
    shared = stage(ordered.mapInArrow(_shared, "name long, doc long, first long"), "repeats-anchors")

    def beside(rows: DataFrame, fields: list[str]) -> DataFrame:
        """Texts and, for each, the marks of its document."""
        marks = stage(rows.groupBy("doc").agg(F.collect_list(F.struct(*fields)).alias("marks")), "repeats-marks")
        asked = with_flag(texts, F.xxhash64("doc"), marks.select(F.xxhash64("doc").alias("key")), "_may").where("_may")
        return asked.hint("merge").join(marks, "doc").select("doc", "text", "marks")

    runs = _over(beside(shared, ["name", "first"]), ["doc", "text", "marks"], _contexts, "name long, context long, doc long, first long, left long, right long")
    # a context has its left side in it, so one order of rows serves both
    of_left, of_run, of_right = (Window.partitionBy("name", *by) for by in (["left"], ["left", "context"], ["right"]))
    judged = runs.repartition("name").withColumn("owner", F.min("doc").over(of_run))
    mine = (F.col("owner") == F.col("doc")) & (F.col("first") < F.col("doc"))
    judged = judged.withColumn("by_left", mine & F.col("left").isNotNull() & (F.min("doc").over(of_left) < F.col("doc")))
    judged = judged.withColumn("by_right", mine & F.col("right").isNotNull() & (F.min("doc").over(of_right) < F.col("doc")))
    # of a side, only the windows of runs that share it with an open run are looked at
    judged = judged.withColumn("ask_right", F.max("by_right").over(of_right)).withColumn("ask_left", F.max("by_left").over(of_left))
    judged = stage(
        judged.where("doc > owner OR ask_left OR ask_right").select(
            "name", "context", "doc", (F.col("doc") > F.col("owner")).alias("whole"), (F.col("by_left") | F.col("by_right")).alias("open"),
            F.col("ask_left").alias("left"), F.col("ask_right").alias("right"),
        ),
        "repeats-runs",
    )
    edges = _over(
        beside(judged.where("NOT whole"), ["name", "context", "open", "left", "right"]), ["doc", "text", "marks"], _edge_windows,
        "name long, window long, doc long, open boolean",
    )
    of_window = Window.partitionBy("name", "window")
    single = edges.repartition("name", "window").withColumn("owner", F.min("doc").over(of_window)).where("open AND owner < doc")
    found = judged.where("whole").select("doc", F.col("context").alias("whole"), F.lit(None).cast("long").alias("single")).unionByName(
        single.select("doc", F.lit(None).cast("long").alias("whole"), F.col("window").alias("single"))
    )
    marks = stage(found.groupBy("doc").agg(F.collect_set("whole").alias("whole"), F.collect_set("single").alias("single")), "repeats-found")
    given = [*dict.fromkeys([*names, text])]
    id_, may, whole, one = (fresh(n, [*given, out]) for n in ("_doc", "_may", "_whole", "_single"))
    source = docs.select(*[F.col(f"`{c}`") for c in given], doc.alias(id_))
    flagged = with_flag(source, F.xxhash64(id_), marks.select(F.xxhash64("doc").alias("key")), may)
    nothing = F.array().cast("array<long>")
    plain = flagged.where(~F.col(may)).withColumns({whole: nothing, one: nothing})
    marked = flagged.where(F.col(may)).hint("merge").join(marks.select(F.col("doc").alias(id_), F.col("whole").alias(whole), F.col("single").alias(one)), id_, "left")
    columns = [*[f"`{c}`" for c in given], whole, one]
    return _judge(plain.select(*columns).unionByName(marked.select(*columns)), text, names, out, whole, one)


def _judge(rows: DataFrame, text: str, names: list[str], out: str, whole_marks: str, single_marks: str) -> DataFrame:
    kind = to_arrow_type(RESULT)
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField(out, RESULT)])

    def one(body: bytes, spans: list[list[int]]) -> dict:
        digest, at = hashlib.sha256(), 0
        for a, b in spans:
            digest.update(body[at:a])
            at = b
        digest.update(body[at:])
        return {"n_bytes": len(body), "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": digest.hexdigest(), "spans": spans}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                bodies = part.column(text).cast(pa.binary()).to_pylist()
                made = []
                for _, texts, wholes, singles in _blocks(bodies, bodies, _numbers(part.column(whole_marks)), _numbers(part.column(single_marks))):
                    # texts without marks lose nothing
                    runs = Runs(*[t if t and len(w) + len(o) else b"" for t, w, o in zip(texts, wholes, singles)])
                    made += [one(t or b"", removed_spans(runs, k, w, o)) for k, (t, w, o) in enumerate(zip(texts, wholes, singles))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(made, type=kind)], names=[*names, out])

    return rows.mapInArrow(run, schema)
