"""Jaccard self-join of documents on word shingles: rare-first prefix filtering, one verification per pair.

Documents with equal shingle sets are one class; all further work is on classes. Each class sends the
first shingles of its set, rarest first, to a shuffle by shingle; two sets as similar as asked for must
meet there. Pairs are thinned by size, by the places of their common shingles (within the prefixes that their
own sizes ask for, and by what remains after the first), by the counts of their parts (suffix filter), first
from counts that classes carry and again when both sets are at hand; what is left is intersected once.

Groups of near copies never yield all their pairs. First rounds compare a class only with central classes
of its prefix shingles, those in whose order a shingle comes first, and with the first class of each of its
hash minima; links found there make components. The last round is complete: it takes every pair that shares a prefix shingle and is not yet in one component.
Together they find the components of all links. Shingles that the same classes have are compared as one.

Frequency order: shingles seen more than once in a stretch of some million are counted across the
table, and as many of the most frequent as ``FREQUENT`` allows are broadcast. The rest count as rare.
Any fixed order gives the right result; this one keeps common passages out of the prefixes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwise.llm.columns import give_back
from strandwise.llm.components import components
from strandwise.llm.filters import with_flag
from strandwise.operators.joins import skew_join
from strandwise.session import stage

WORDS = 5
SHARE = (75, 100)  # least intersection as a share of the union
FREQUENT = 1 << 20  # most shingles in the broadcast frequency table
STRETCH = 1 << 22  # shingles counted together in a task
BLOOM_WORDS = 1 << 18  # 64-bit words of the filter for the sets to fetch: 2 MB, false hits are harmless
PARTS = 16  # of a set in the suffix filter
RANGES = 256  # of hashes in which a class counts its shingles, for the bound that needs no sets
PER_RANGE = 2  # most shingles a range holds on average; larger sets have more ranges, as full ranges tell little
MINIMA = 8  # hash minima by which a class finds a near one
ALIKE = 5  # minima that two classes share when they are compared before the complete round
LEAST_YIELD = 10  # a round that links under one in so many of its pairs is the last before the complete one
HOT_PAIRS = 1 << 10  # pairs of one class that a task gives its shingles to
CHUNK = 1 << 20  # bytes hashed at a time
ROWS = 256

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the word hash and of its inverse, modulo 2**64."""
    parts = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        parts.append(np.cumprod(p, dtype=np.uint64))
    return parts[0], parts[1]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of the text with its letters A-Z made small.

    A word's polynomial hash is the difference of two running sums over the text, brought back to the
    power 0. Texts are cut between words after ``CHUNK`` bytes.
    """
    parts, at = [], 0
    while gap := _SPACE.search(text, at + CHUNK):
        parts.append(_piece_hashes(text[at : gap.start()]))
        at = gap.start()
    return np.concatenate([*parts, _piece_hashes(text[at:])])


def _piece_hashes(text: bytes) -> np.ndarray:
    letters = np.frombuffer(text.lower(), dtype=np.uint8)
    if not len(letters):
        return np.empty(0, dtype=np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _WHITE[letters], [True]])))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _powers(1 << max(12, int(len(letters)).bit_length()))
    total = np.zeros(len(letters) + 1, dtype=np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * power[: len(letters)], out=total[1:])
    return _mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _FACTORS[0])


def shingles_of(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a text of fewer words is one shingle."""
    words = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    n = min(WORDS, len(words))
    if not n:
        return words
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h += words[k : len(words) - n + 1 + k] * _FACTORS[k]
    h = np.sort(_mixed(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def class_of(shingles: np.ndarray) -> int | None:
    """A name for the set; None for the empty one."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


def least_part(n: int) -> int:
    """Least size of the intersection with, and of, a set that links with one of size n."""
    return -(-n * SHARE[0] // SHARE[1])


def prefix_size(n: int) -> int:
    return n - least_part(n) + 1


# --- passes over the texts -----------------------------------------------------------------------


def _pass(texts: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(rows of (id, row, text)) -> batches`` over each task's rows in small lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    yield part.column("id"), part.column("row"), part.column("text").cast(pa.binary()).to_pylist()

        give_back()
        yield from fn(rows())

    return texts.mapInArrow(run, schema)


def _signatures(rows) -> Iterator[pa.RecordBatch]:
    """A row per text (id, n, cls), and rows (shingle, count) for what is frequent in a stretch."""
    stretch: list[np.ndarray] = []
    held, seen, kinds = 0, set(), (pa.null(), pa.int64())

    def counted() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(stretch), return_counts=True)
        return _counts(kinds, keys[n > 1].view(np.int64), n[n > 1])

    for ids, row, texts in rows:
        kinds = ids.type, row.type
        sets = [shingles_of(t) for t in texts]
        names = [class_of(s) for s in sets]
        nothing = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                ids, row, pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), nothing, nothing,
                pa.array([_minima(s) for s in sets], _MINIMA), pa.array([_ranges(s) for s in sets], pa.binary()),
            ],
            names=_SIGNED,
        )
        for s, name in zip(sets, names):
            if name is not None and name not in seen:
                seen.add(name)
                stretch.append(s)
                held += len(s)
        if held > STRETCH:
            yield counted()
            stretch, held = [], 0
            seen.clear()
    if stretch:
        yield counted()


_SIGNED = ["id", "row", "n", "cls", "shingle", "count", "minima", "ranges"]
_MINIMA = pa.list_(pa.int64())
_TURNS = _mixed(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def _minima(shingles: np.ndarray) -> np.ndarray | None:
    """The smallest shingle in each of some orders; two sets share one as often as they are similar."""
    return np.array([(shingles * t).min() for t in _TURNS]).view(np.int64) if len(shingles) else None


def _counts(kinds: tuple[pa.DataType, ...], keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    nothing = pa.nulls(len(keys), pa.int64())
    empty = [pa.nulls(len(keys), k) for k in kinds]
    return pa.RecordBatch.from_arrays([*empty, nothing, nothing, pa.array(keys), pa.array(n), pa.nulls(len(keys), _MINIMA), pa.nulls(len(keys), pa.binary())], names=_SIGNED)


def _ranges(shingles: np.ndarray) -> bytes | None:
    """How many shingles lie in each range of hashes: the width of a count, then the counts of 2**k ranges."""
    if not len(shingles):
        return None
    bits = max(RANGES - 1, (len(shingles) - 1) // PER_RANGE).bit_length()
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    width = next(w for w in (1, 2, 4) if counts.max() < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"u{width}").tobytes()


def _counts_of(ranges: bytes) -> np.ndarray:
    return np.frombuffer(ranges, dtype=f"u{ranges[0]}", offset=1)


def may_link(ranges: tuple[bytes, bytes]) -> bool:
    """Whether two classes can have enough in common: at most the smaller count of each range, the finer ranges summed up."""
    x, y = sorted((_counts_of(r) for r in ranges), key=len)
    y = y.reshape(len(x), -1).sum(axis=1, dtype=np.int64)
    needed = -(-(int(x.sum(dtype=np.int64)) + int(y.sum())) * SHARE[0] // (SHARE[0] + SHARE[1]))
    return int(np.minimum(x, y).sum(dtype=np.int64)) >= needed


def _prefixes(keys: np.ndarray, counts: np.ndarray):
    def fn(rows) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, texts in rows:
            out = []
            for t in texts:
                s = shingles_of(t)
                name = class_of(s)
                if name is None or name in seen:
                    continue
                seen.add(name)
                rank = np.zeros(len(s), dtype=np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    rank = np.where(keys[at] == s, counts[at], 0)
                first = np.argsort(rank, kind="stable")[: prefix_size(len(s))]
                out.append((s[first].view(np.int64), name, len(s)))
            if len(seen) > STRETCH:
                seen.clear()
            if out:
                sizes = [len(o[0]) for o in out]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([o[0] for o in out])), pa.array(np.repeat([o[1] for o in out], sizes)),
                    pa.array(np.repeat([o[2] for o in out], sizes).astype(np.int32)),
                    pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])),
                ], names=["shingle", "cls", "n", "pos"])

    return fn


def _sets(bloom: np.ndarray):
    def fn(rows) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, texts in rows:
            found = {}
            for t in texts:
                s = shingles_of(t)
                name = class_of(s)
                if name is not None and name not in seen and _may_hold(bloom, name):
                    found[name] = s.tobytes()
            seen.update(found)
            if len(seen) > STRETCH:
                seen.clear()
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["cls", "body"]
                )

    return fn


def _may_hold(bloom: np.ndarray, name: int) -> bool:
    bits = name & (BLOOM_WORDS * 64 - 1)
    return bool(int(bloom[bits >> 6]) >> (bits & 63) & 1)


def _bloom(names: DataFrame) -> np.ndarray:
    """One bit per name; at most BLOOM_WORDS rows reach the driver."""
    bits = F.col("cls").bitwiseAND(F.lit(BLOOM_WORDS * 64 - 1))
    words = names.select(F.shiftright(bits, 6).alias("w"), F.expr(f"shiftleft(1L, cast(cls & 63 as int))").alias("m"))
    got = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bloom = np.zeros(BLOOM_WORDS, dtype=np.uint64)
    bloom[got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
    return bloom


# --- candidates ----------------------------------------------------------------------------------


def _leaders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shingle, place and class: those of shingles with several classes, with their first two.

    Between batches only the first two rows of the current shingle are kept, and the last row's class.
    """
    held: np.ndarray | None = None  # rows of shingle, cls, n, pos
    written = False  # has the first of them gone out?
    last: tuple[int, int] | None = None
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shingle", "cls", "n", "pos")])
        if not rows.shape[1]:
            continue
        pair = rows[:2]
        fresh = np.concatenate([[last != tuple(pair[:, 0].tolist())], (pair[:, 1:] != pair[:, :-1]).any(axis=0)])
        last = tuple(pair[:, -1].tolist())
        rows = rows[:, fresh]
        if not rows.shape[1]:
            continue
        old = 0
        if held is not None and held[0, 0] == rows[0, 0]:
            old = held.shape[1]
            rows = np.concatenate([held, rows], axis=1)
        shingle = rows[0]
        place = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        size = np.diff(np.concatenate([place, [len(shingle)]]))
        run = np.repeat(np.arange(len(place)), size)
        within = np.arange(len(shingle)) - place[run]
        out = (size > 1)[run]
        out[1:old] = False
        out[0] &= not (old and written)
        held, written = rows[:, place[-1] : place[-1] + 2].copy(), bool(size[-1] > 1)
        pick = np.flatnonzero(out)
        if len(pick):
            first = place[run[pick]]
            leads = []
            for k in range(2):
                at = np.minimum(first + k, len(shingle) - 1)
                leads += [pa.array(rows[c, at], t, mask=within[pick] <= k) for c, t in ((1, pa.int64()), (2, pa.int32()))]
            own = [pa.array(rows[c, pick], t) for c, t in enumerate(_LED.types[:4])]
            yield pa.RecordBatch.from_arrays([*own, *leads], schema=_LED)


_LED = pa.schema([
    ("shingle", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()),
    ("lead1", pa.int64()), ("lead1_n", pa.int32()), ("lead2", pa.int64()), ("lead2_n", pa.int32()),
])
_LED_SQL = "shingle long, cls long, n int, pos int, lead1 long, lead1_n int, lead2 long, lead2_n int"


def _part(n: Column) -> Column:
    return F.ceil(n * SHARE[0] / SHARE[1])


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * SHARE[1] >= F.greatest(a, b) * SHARE[0]


def _needed(a: Column, b: Column) -> Column:
    """Least intersection of linked sets of these sizes: share / (1 + share) of their sum."""
    return F.ceil((a + b) * SHARE[0] / (SHARE[0] + SHARE[1]))


def _common(a: Column, b: Column) -> Column:
    """Least number of common prefix shingles of linked sets: what lies beyond the shorter-reaching
    prefix is at most the rest of that set."""
    return F.greatest(F.lit(1), _needed(a, b) - F.greatest(_part(a), _part(b)) + 1)


def _thinned(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs whose counts per range of hashes leave room for a link: two sets have at most the smaller count of each
    range in common. A byte or less per shingle, a quarter of a kilobyte at least, tells most unlinked pairs."""
    names = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    rows = with_flag(signed.where("cls IS NOT NULL").select("cls", "ranges"), F.xxhash64("cls"), names.select(F.xxhash64("cls").alias("key")), "may")
    held = stage(rows.where("may").select("cls", "ranges").dropDuplicates(["cls"]), "join-ranges")
    return _with_both(pairs, held, "ranges").mapInArrow(_room, "a long, b long")


def _with_both(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """``a, b, x, y``: the pairs of a written table with the column of both classes. The pairs of a central class are
    dealt out in parts, each of which gets what the class holds once."""
    out = pairs
    for side, other, name in (("a", "b", "x"), ("b", "a", "y")):
        counts = pairs.groupBy(side).agg(F.count("*").alias("n"))
        values = held.select(F.col("cls").alias(side), F.col(column).alias(name))
        out = skew_join(out, values, [side], spread=[other], counts=counts, hot_rows=HOT_PAIRS)
    return out.select("a", "b", "x", "y")


def _room(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        mask = pa.array([may_link((x.as_py(), y.as_py())) for x, y in zip(batch.column("x"), batch.column("y"))], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])


def _linked(pairs: DataFrame, texts: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked for. ``pairs`` is a written table."""
    pairs = stage(_thinned(pairs, signed), "join-thinned")
    names = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    bloom = texts.sparkSession.sparkContext.broadcast(_bloom(names))
    sets = _pass(texts, lambda rows: _sets(bloom.value)(rows), "cls long, body binary")
    sets = stage(sets.join(names.distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "join-sets")
    return _with_both(pairs, sets, "body").mapInArrow(_verify, "a long, b long")


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pivots = (np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS))
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            needed = -(-(len(x) + len(y)) * SHARE[0] // (SHARE[0] + SHARE[1]))
            parts = [np.diff(np.searchsorted(s, pivots), prepend=0, append=len(s)) for s in (x, y)]
            # parts of unequal size differ in at least as many shingles
            if (len(x) + len(y) - int(np.abs(parts[0] - parts[1]).sum())) // 2 < needed:
                keep.append(False)
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common * SHARE[1] >= (len(x) + len(y) - common) * SHARE[0])
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])


# --- the operator --------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_shingles``, ``component`` (the smallest id it reaches).

    Null texts and texts without words have no shingles and link with nothing. Equal texts, and rows that
    repeat an id, link by their texts. A component of null ids alone has the component null. Other
    columns are ignored. An empty table gives an empty table.
    """
    classes, roots = classes_and_roots(docs, text, doc_id)
    rooted = stage(classes.join(roots, "cls", "left").select("id", "n", F.coalesce("root", "cls").alias("root")), "join-rooted")
    smallest = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component"))
    return rooted.join(smallest, "root", "left").select(
        "id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component")
    )


def classes_and_roots(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``id, row, n, cls`` of every row, and ``cls, root`` of the classes that link with another."""
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), row_key(doc_id, text).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    signed = stage(_pass(texts, _signatures, f"id {kind}, row long, n long, cls long, shingle long, count long, minima array<long>, ranges binary"), "join-signatures")
    classes = signed.where("shingle IS NULL").select("id", "row", "n", "cls")
    counted = signed.where("shingle IS NOT NULL")
    total = counted.agg(F.sum("count")).first()[0] or 0
    # no more than total / least shingles can be as frequent as that
    least = max(2, -(-total // FREQUENT))
    table = counted.groupBy("shingle").agg(F.sum("count").alias("count")).where(F.col("count") >= least).toArrow()
    keys = table["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    frequent = texts.sparkSession.sparkContext.broadcast((keys[order], table["count"].to_numpy()[order]))
    prefixes = _pass(texts, lambda rows: _prefixes(*frequent.value)(rows), "shingle long, cls long, n int, pos int")
    ordered = prefixes.repartition("shingle").sortWithinPartitions("shingle", "pos", "cls")
    led = stage(ordered.mapInArrow(_leaders, _LED_SQL), "join-prefixes")

    tried = stage(_central_pairs(led), "join-pairs")
    links = stage(_linked(tried, texts, signed), "join-links")
    near = stage(_near_pairs(signed, components(links)).join(tried, ["a", "b"], "left_anti"), "join-pairs")
    tried, links = tried.unionByName(near), links.unionByName(stage(_linked(near, texts, signed), "join-links"))
    groups = stage(_groups(led), "join-groups")
    while True:
        roots = components(links)
        mixed = stage(_mixed_groups(groups, roots), "join-mixed")
        pairs = stage(_leader_pairs(mixed).join(tried, ["a", "b"], "left_anti"), "join-pairs")
        asked = pairs.count()
        if not asked:
            break
        found = stage(_linked(pairs, texts, signed), "join-links")
        tried, links = tried.unionByName(pairs), links.unionByName(found)
        if found.count() * LEAST_YIELD < asked:
            roots = components(links)
            mixed = stage(_mixed_groups(groups, roots), "join-mixed")
            break
    rest = stage(_other_pairs(mixed).join(tried, ["a", "b"], "left_anti"), "join-pairs")
    if not rest.isEmpty():
        more = stage(_linked(rest, texts, signed), "join-links")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    return classes, roots.withColumnRenamed("node", "cls")


def _central_pairs(led: DataFrame) -> DataFrame:
    """Every class with the first two classes of each of its prefix shingles."""
    leads = F.array(*[F.struct(F.col(c).alias("c"), F.col(f"{c}_n").alias("cn")) for c in ("lead1", "lead2")])
    pairs = led.select("cls", "n", F.explode(leads).alias("lead")).select("cls", "n", "lead.c", "lead.cn", F.lit(1).alias("w"))
    return _counted(pairs.where("c IS NOT NULL"))


def _near_pairs(signed: DataFrame, roots: DataFrame) -> DataFrame:
    """Every class with the first class that has one of its hash minima, where both are in different components."""
    own = signed.where("cls IS NOT NULL").select("cls", "n", "minima").dropDuplicates(["cls"]).select("cls", "n", F.posexplode("minima").alias("k", "m"))
    first = own.groupBy("k", "m").agg(F.min("cls").alias("c"), F.max("cls").alias("z")).where("c <> z").select("k", "m", "c")
    pairs = own.join(first, ["k", "m"]).where("cls <> c").select("c", "cls").distinct()
    up = lambda c, r: roots.select(F.col("node").alias(c), F.col("root").alias(r))
    pairs = pairs.join(up("c", "x"), "c", "left").join(up("cls", "y"), "cls", "left")
    pairs = pairs.where(F.coalesce("x", "c") != F.coalesce("y", "cls")).select("c", "cls")
    # as minima are few numbers and sets are long, pairs that share few of them wait for the complete round
    held = lambda c, m: signed.where("cls IS NOT NULL").select(F.col("cls").alias(c), F.col("minima").alias(m)).dropDuplicates([c])
    met = pairs.join(held("c", "mx"), "c").join(held("cls", "my"), "cls")
    alike = F.size(F.filter(F.zip_with("mx", "my", lambda x, y: x == y), lambda same: same))
    return met.where(alike >= ALIKE).select(F.col("c").alias("a"), F.col("cls").alias("b"))


def _counted(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of (cls, n, c, cn, w) that share about as many prefix shingles as linked sets do."""
    pairs = pairs.where(_sizes_fit(F.col("n"), F.col("cn")))
    small = F.col("cls") < F.col("c")
    pairs = pairs.select(
        F.least("cls", "c").alias("a"), F.greatest("cls", "c").alias("b"),
        F.when(small, F.col("n")).otherwise(F.col("cn")).alias("na"), F.when(small, F.col("cn")).otherwise(F.col("n")).alias("nb"), "w",
    )
    counted = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("w").alias("common"))
    return counted.where(F.col("common") * 2 >= _common(F.col("na"), F.col("nb"))).select("a", "b")


def _groups(led: DataFrame) -> DataFrame:
    """``g, cls, n, pos, w``: prefix shingles that the same classes have are one group of ``w`` shingles.

    A group is named by the sums of its classes; ``pos`` is the place of a class's first shingle in it.
    """
    rows = led.select("shingle", "cls", "n", "pos")
    names = rows.groupBy("shingle").agg(
        F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"), F.count("*").alias("c")
    ).select("shingle", F.xxhash64("x", "y", "c").alias("g"))
    return rows.join(names, "shingle").groupBy("g", "cls", "n").agg(F.min("pos").alias("pos"), F.count("*").alias("w"))


def _mixed_groups(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """The groups whose classes are not yet in one component, with the components."""
    named = groups.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    several = named.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("g")
    return named.join(several, "g", "left_semi")


def _leader_pairs(mixed: DataFrame) -> DataFrame:
    """Every class with the most central class of another component in each of its groups."""
    row = F.struct("pos", "cls", "n", "root")
    first = mixed.groupBy("g").agg(F.min(row).alias("p"))
    led = mixed.join(first, "g")
    second = led.where(F.col("root") != F.col("p.root")).groupBy("g").agg(F.min(row).alias("q"))
    partner = F.when(F.col("root") != F.col("p.root"), F.col("p")).otherwise(F.col("q"))
    pairs = led.join(second, "g").select("cls", "n", "w", F.explode(F.array(partner)).alias("o"))
    return _counted(pairs.select("cls", "n", F.col("o.cls").alias("c"), F.col("o.n").alias("cn"), "w"))


def _other_pairs(mixed: DataFrame) -> DataFrame:
    """All pairs of different components that can be linked.

    Sets that share ``needed`` shingles share one among the first ``n - needed + 1`` of each. Both places are
    asked for before rows are made, so classes that meet only behind shingles of their own never form a pair.
    """
    x, y = (mixed.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "pos", "root")]) for s in ("a", "b"))
    na, nb, i, j = (F.col(c) for c in ("n_a", "n_b", "pos_a", "pos_b"))
    within = (i <= na - _needed(na, nb)) & (j <= nb - _needed(na, nb))
    pairs = x.join(y, "g").where((F.col("cls_a") < F.col("cls_b")) & (F.col("root_a") != F.col("root_b")) & _sizes_fit(na, nb) & within)
    first = pairs.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), "n_a", "n_b").agg(F.min("pos_a").alias("pos_a"), F.min("pos_b").alias("pos_b"))
    # from the first common shingle on, the shorter rest bounds the intersection
    return first.where(F.least(na - i, nb - j) >= _needed(na, nb)).select("a", "b")


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component stays, that of the smallest id (null last); of equal rows one. Columns unchanged.

    Rows without words link with nothing and stay. Only rows that may go are shuffled with their texts: the
    keys of those that go set bits in a filter of bounded size, and the others pass it where they are.
    """
    classes, roots = classes_and_roots(docs, text, doc_id)
    rooted = classes.where("cls IS NOT NULL").join(roots, "cls", "left").select("id", "row", F.coalesce("root", "cls").alias("root"))
    rows = stage(rooted.groupBy("root", "id", "row").agg(F.count("*").alias("copies")), "join-rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best"))
    judged = rows.join(best, "root").select("row", (F.col("row") == F.col("best.row")).alias("stays"), "copies")
    special = stage(judged.where("NOT stays OR copies > 1").groupBy("row").agg(F.max("stays").alias("stays")), "join-special")
    # the user's row travels as one struct, so its columns may have any names
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("kept"), row_key(doc_id, text).alias("row"))
    marked = with_flag(packed, F.col("row"), special.select(F.col("row").alias("key")), "may_go")
    asked = marked.where("may_go").join(special, "row", "left").where(F.coalesce("stays", F.lit(True)))
    # rows of one key have one id and text; the first by its hash stays, whatever the partitioning
    place = F.when(F.col("stays"), F.row_number().over(Window.partitionBy("row").orderBy(F.xxhash64("kept")))).otherwise(1)
    asked = asked.withColumn("place", place).where("place = 1")
    whole = marked.where("NOT may_go").select("kept").unionByName(asked.select("kept"))
    return whole.select(*[F.col("kept")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
