"""Near duplicates among embeddings: randomised-rotation binary codes, bounds, exact recomputation.

Each vector is scaled to length 1 and rotated at random; its code is the signs, its correction factor
the inner product of the rotated vector with the code. For a vector y the estimate
``<code, rotated y> / factor`` of ``<x, y>`` is unbiased, with a deviation known from the factor. A pair is
computed exactly, in double precision, only when the upper confidence bound of its estimate reaches
the threshold.

Candidates come from bit groups of further rotations: a table per group, vectors with equal bits in a
bucket. The number of bits follows the largest label, so that buckets stay small at any size, and the
number of tables follows from the bits, so that a pair at the threshold is missed by all with a
probability of at most ``MISS``. A pair is counted in the first table where it meets, so pairs are never
shuffled or written: tasks return link counts per vector and the edges of spanning trees. Buckets
beyond ``TILE`` vectors are cut into pairs of tiles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandwise.llm.components import components
from strandwise.session import stage

THRESHOLD = 0.93
BUCKET = 32  # mean vectors of the largest label in a bucket
TILE = 1024
MISS = 1e-5
DEVIATIONS = 5.0  # of the estimate, in the confidence bound
SEED = 11


def tables_for(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    agree = (1 - acos(threshold) / pi) ** bits
    return max(1, ceil(log(miss) / log(1 - agree)))


@cache
def rotation(dims: int, number: int) -> np.ndarray:
    """A random orthogonal matrix; equal on every executor."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dims, number]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def rotated(x: np.ndarray, count: int, first: int) -> np.ndarray:
    """``count`` coordinates from as many rotations as it takes."""
    dims = x.shape[1]
    parts = [x @ rotation(dims, first + k) for k in range(-(-count // dims))]
    return np.hstack(parts)[:, :count]


def usable(vector: Column, label: Column) -> Column:
    """Can the row link with anything: no null or non-finite component, not zero, label known?"""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_duplicates(
    rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, tile: int = TILE, bucket: int = BUCKET,
) -> DataFrame:
    """One row per row of ``rows``: ``id``, ``n_links``, ``component``, ``kept``.

    Vectors of equal label and length link when their cosine reaches ``threshold``. Rows whose vector is
    null, empty, zero or holds null or non-finite components, and rows without a label, link with nothing
    and are their own component. Equal vectors are compared once and counted as often as they come.
    Null ids take part; a component's id is its smallest id that is not null. Repeated ids count as
    rows of their own; other columns are ignored.
    """
    named = rows.select(
        F.col(f"`{id_}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.col(f"`{label}`").cast("string").alias("label")
    ).withColumn("ok", usable(F.col("v"), F.col("label")))
    # the hash names a vector; equal vectors of a label are one class. The label's length tells where it ends.
    digest = F.when(F.col("ok"), F.unhex(F.md5(F.concat_ws(",", F.octet_length("label").cast("string"), F.col("label"), F.col("v").cast("array<string>")))))
    named = named.withColumn("cls", digest)
    members = stage(named.select("id", "cls"), "vectors-members")
    classes = stage(
        named.where("ok").groupBy("cls").agg(F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.count("*").alias("copies")),
        "vectors-classes",
    )
    groups = classes.groupBy("label", F.size("v").alias("dims")).agg(F.count("*").alias("n"))
    most = groups.agg(F.max("n")).first()[0] or 1
    bits = max(4, ceil(log2(max(1, most / bucket))))
    tables = tables_for(bits, threshold)
    found = stage(_links(classes, bits, tables, threshold, tile), "vectors-links")
    linked = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    tree = classes.select("cls", "copies").join(linked, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    tree = stage(tree.select("cls", F.coalesce("root", "cls").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vectors-tree")
    smallest = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("id")).join(tree, "cls")
    smallest = smallest.groupBy("root").agg(F.min("id").alias("component"))
    by_class = stage(tree.join(smallest, "root").select("cls", "n_links", "component"), "vectors-classes-done")
    out = members.join(by_class, "cls", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def _links(classes: DataFrame, bits: int, tables: int, threshold: float, tile: int) -> DataFrame:
    """``cls, links, other``: partial link counts of classes, and edges of spanning trees."""

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                column = part.column("v")
                sizes = np.diff(column.offsets.to_numpy())
                flat = column.flatten().to_numpy(zero_copy_only=False)
                place = np.cumsum(sizes) - sizes
                for dims in np.unique(sizes).tolist():
                    pick = np.flatnonzero(sizes == dims)
                    x = flat[place[pick][:, None] + np.arange(dims)]
                    x = x / np.abs(x).max(axis=1, keepdims=True)  # far from overflow
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    turned = rotated(x, dims, 0)
                    factor = np.abs(turned).sum(axis=1) / np.sqrt(dims)
                    keys = rotated(x, bits * tables, 1).reshape(len(x), tables, bits) > 0
                    keys = (keys * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                    yield pa.RecordBatch.from_arrays([
                        part.column("cls").take(pa.array(pick)), part.column("label").take(pa.array(pick)),
                        part.column("copies").take(pa.array(pick)), pa.array(np.full(len(pick), dims, dtype=np.int32)),
                        pa.array([r.tobytes() for r in x]), pa.array([r.tobytes() for r in np.packbits(turned > 0, axis=1)]),
                        pa.array(factor), pa.array(keys.tolist(), type=pa.list_(pa.int64())),
                    ], names=["cls", "label", "copies", "dims", "x", "code", "factor", "keys"])

    schema = "cls binary, label string, copies long, dims int, x binary, code binary, factor double, keys array<long>"
    coded = stage(classes.mapInArrow(code, schema), "vectors-codes")
    place = ["label", "dims", "t", "key"]
    dealt = coded.select("*", F.posexplode("keys").alias("t", "key"))
    # vectors of a full bucket meet in pairs of tiles; one row per such bucket
    full = stage(
        dealt.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > tile).select(*place, F.ceil(F.col("n") / tile).cast("int").alias("tiles")),
        "vectors-full-buckets",
    )
    tiled = dealt.join(full, place, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
    tiled = tiled.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select(
        *place, F.least("own", "with").alias("ti"), F.greatest("own", "with").alias("tj"), (F.col("own") <= F.col("with")).alias("left"),
        (F.col("own") >= F.col("with")).alias("right"), "cls", "copies", "x", "code", "factor", "keys",
    )
    group = [*place, "ti", "tj"]
    ordered = tiled.repartition(*group).sortWithinPartitions(*group)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for row in batch.slice(at, 1024).to_pylist():
                    if held and any(held[-1][g] != row[g] for g in group):
                        yield from _tile(held, threshold)
                        held = []
                    held.append(row)
        if held:
            yield from _tile(held, threshold)

    return ordered.mapInArrow(meet, "cls binary, links long, other binary")


_LINKS = pa.schema([("cls", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])


def _tile(rows: list[dict], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between the vectors of a tile pair that no earlier table has."""
    if len(rows) < 2:
        return
    dims, t = rows[0]["dims"], rows[0]["t"]
    x = np.frombuffer(b"".join(r["x"] for r in rows)).reshape(-1, dims)
    codes = np.unpackbits(np.frombuffer(b"".join(r["code"] for r in rows), dtype=np.uint8).reshape(len(rows), -1), axis=1)[:, :dims]
    factor = np.array([r["factor"] for r in rows])
    left = np.flatnonzero([r["left"] for r in rows])
    right = np.flatnonzero([r["right"] for r in rows])
    turned = x @ rotation(dims, 0)
    signs = (codes[left].astype(np.float64) * 2 - 1) / np.sqrt(dims)
    estimate = (signs @ turned[right].T) / factor[left][:, None]
    spread = np.sqrt(np.maximum(0, 1 - factor[left] ** 2)) / factor[left] / np.sqrt(max(1, dims - 1))
    likely = estimate + DEVIATIONS * spread[:, None] >= threshold
    i, j = np.nonzero(likely)
    i, j = left[i], right[j]
    # within one tile every pair is seen from both sides
    once = i < j if rows[0]["ti"] == rows[0]["tj"] else i != j
    i, j = i[once], j[once]
    if t and len(i):
        keys = np.array([r["keys"][:t] for r in rows], dtype=np.int64)
        fresh = np.concatenate([~(keys[i[k : k + 65536]] == keys[j[k : k + 65536]]).any(axis=1) for k in range(0, len(i), 65536)])
        i, j = i[fresh], j[fresh]
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.empty(0)])
    i, j = i[exact >= threshold], j[exact >= threshold]
    if not len(i):
        return
    copies = np.array([r["copies"] for r in rows], dtype=np.int64)
    links = np.bincount(i, weights=copies[j], minlength=len(rows)) + np.bincount(j, weights=copies[i], minlength=len(rows))
    root = list(range(len(rows)))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    out = [
        {"cls": rows[k]["cls"], "links": int(links[k]), "other": rows[r]["cls"] if (r := find(k)) != k else None}
        for k in np.flatnonzero(links).tolist()
    ]
    yield pa.RecordBatch.from_pylist(out, schema=_LINKS)
