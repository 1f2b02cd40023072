"""Sharding by a k-d tree: weighted medians along the widest metadata dimension until every leaf has its bytes.

Everything here is DataFrame operations over a written table of sizes and metadata; texts stay where they are. A node
that stands for k shards is cut where its first ``k div 2`` shards' share of the bytes ends, in the order (value of
its widest dimension, hash of the id, number of the row). The last part tells any two rows apart, so one value, one
id or one group of copies may hold any share of the rows and is cut inside.

No node is ever sorted. Bytes are summed per bin of the order on the map side, the bin that holds the cut is
dealt into bins again, and only when few rows are left they are summed one by one. All nodes of a level go together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwise.operators.ordering import rank_globally
from strandwise.session import stage

BINS = 4096  # bins a node's order is dealt into per round
SORT_ROWS = 1 << 14  # rows of one bin that are summed one by one
BROADCAST_NODES = 1 << 16  # cuts (some hundred bytes each) that are sent to every task; beyond, rows meet them by node
HASH_DIGITS = 13
LAST_ROW = (1 << 63) - 1


def first_letters(text: str | Column) -> Column:
    """A whole number that keeps the order of strings, by their first six bytes; -1 for null."""
    name = F.col(text) if isinstance(text, str) else text
    digits = F.rpad(F.hex(F.substring(name.cast("binary"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(-1).cast("long"))


def text_bytes(text: str | Column) -> Column:
    """UTF-8 bytes plus 1; 1 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, size: Column | None = None,
    dimensions: Sequence[Column] | None = None, doc_id: str = "doc_id", out: str = "shard", keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` columns (all by default) with the struct ``out``: ``size, shard, slot``.

    Either ``shards`` leaves, or as many as let none pass ``target_bytes`` by more than a row's size at each cut.
    ``size`` is a positive number of bytes, by default that of ``text`` plus 1. ``dimensions`` are whole numbers
    between -2^62 and 2^62: by default the first letters of ``source`` and ``lang``, and the size. The widest
    dimension of a node is the one whose range is the largest part of its range over the table, the earlier at ties.
    Shards are numbered from the left, slots from 0 inside each in the order of the ids' hashes.

    Null values of a dimension come first, null ids share one hash, null texts have no bytes. Rows alike in every
    column are cut by their place in the table that this writes, so they too are dealt evenly. With fewer rows than
    shards some shards stay empty. An empty table gives an empty table. A column called ``out`` is replaced, other
    columns stay whatever their names.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    size = text_bytes("text") if size is None else size
    axes = [first_letters("source"), first_letters("lang"), size] if dimensions is None else list(dimensions)
    digest = F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary"))
    rows = stage(
        docs.select(
            F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"),
            F.monotonically_increasing_id().alias("r"), size.cast("long").alias("size"),
            F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long").alias("h"),
            F.array(*[F.coalesce(a.cast("long"), F.lit(-1)) for a in axes]).alias("d"), F.lit(0).alias("node"),
        ),
        "shard-rows",
    )
    extent = rows.agg(F.sum("size"), *[F.max(F.col("d")[i]) - F.min(F.col("d")[i]) for i in range(len(axes))]).first()
    if shards is None:
        shards = max(1, -(-(extent[0] or 0) // target_bytes))
    placed = rows.select("r", "size", "h", "d", "node", F.lit(shards).alias("k"))
    most, nodes = shards, 1
    while most > 1:
        small = nodes <= BROADCAST_NODES
        cuts = _cuts(placed.where("k > 1"), extent[1:], small)
        placed = stage(_split(placed, cuts, small), "shard-level")
        most, nodes = most - most // 2, 2 * nodes
    before = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    counts = placed.groupBy("node").agg(F.count("*").alias("n"))
    starts = stage(counts.select("node", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "shard-starts")
    ranked = rank_globally(placed.select("node", "h", "r"), "node", "h", "r").join(_sent(starts, nodes <= BROADCAST_NODES), "node")
    found = ranked.select("r", F.col("node").alias("shard"), (F.col("rank") - 1 - F.col("start")).alias("slot"))
    done = rows.select("r", "row", "size").join(found, "r")
    kept = [F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)]
    return done.select(*kept, F.struct("size", "shard", "slot").alias(out))


def write_shards(sharded: DataFrame, folder: str, out: str = "shard") -> None:
    """Writes the rows as Parquet, a folder ``out=n`` per shard, each file's rows in the order of their slots."""
    names = [F.col(f"`{c}`") for c in sharded.columns if c != out]
    place = sharded.select(*names, F.col(out)["shard"].alias(out), F.struct(F.col(out)["slot"].alias("slot")).alias(f"{out} slot"))
    place.orderBy(out, f"{out} slot").drop(f"{out} slot").write.partitionBy(out).parquet(folder)


def _sent(table: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(table) if small else table


def _cuts(rows: DataFrame, extent: Sequence[int | None], small: bool) -> DataFrame:
    """Per node: ``node, axis, cut, with_cut``; the left part is what lies below ``cut``, or at it if ``with_cut``."""
    number = range(len(extent))
    stats = rows.groupBy("node", "k").agg(
        F.sum("size").alias("total"), F.array(*[F.min(F.col("d")[i]) for i in number]).alias("low"),
        F.array(*[F.max(F.col("d")[i]) for i in number]).alias("high"),
    )
    parts = F.array(*[
        (F.col("high")[i] - F.col("low")[i]).cast("double") / F.lit(float(extent[i])) if extent[i] else F.lit(0.0) for i in number
    ])
    share = F.expr("greatest(1, (2 * cast(total as decimal(38, 0)) * (k div 2)) div k)").cast("long")
    state = stage(
        stats.withColumn("parts", parts).withColumn("axis", (F.array_position("parts", F.array_max("parts")) - 1).cast("int")).select(
            "node", "axis", share.alias("twice"), F.lit(0).cast("long").alias("before"), F.lit(0).alias("part"),
            F.lit(None).cast("long").alias("at_v"), F.lit(None).cast("long").alias("at_h"),
            F.col("low")[F.col("axis")].alias("lo"), F.col("high")[F.col("axis")].alias("hi"),
        ),
        "shard-nodes",
    )
    ready: DataFrame | None = None
    while True:
        state = stage(_narrowed(rows, state, small), "shard-bins")
        done = state.where(F.col("n") <= SORT_ROWS).drop("n")
        ready = done if ready is None else ready.unionByName(done)
        if state.where(F.col("n") > SORT_ROWS).isEmpty():
            break
        state = state.where(F.col("n") > SORT_ROWS).drop("n")
    key = F.struct("v", "h", "r")
    run = Window.partitionBy("node").orderBy("v", "h", "r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = _inside(rows, ready, small).withColumn("run", F.col("before") + F.sum("size").over(run))
    taken = 2 * F.col("run") - F.col("size") <= F.col("twice")
    edge = inside.groupBy("node", "axis").agg(F.max(F.when(taken, key)).alias("last"), F.min(key).alias("least"))
    return stage(edge.select("node", "axis", F.coalesce("last", "least").alias("cut"), F.col("last").isNotNull().alias("with_cut")), "shard-cuts")


def _inside(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """The rows of each node's open stretch of the order, with ``v`` (value on its axis) and ``key`` (the part dealt now)."""
    placed = rows.join(_sent(state, small), "node").withColumn("v", F.col("d")[F.col("axis")])
    placed = placed.withColumn("key", F.when(F.col("part") == 0, F.col("v")).when(F.col("part") == 1, F.col("h")).otherwise(F.col("r")))
    same_v = (F.col("part") == 0) | (F.col("v") == F.col("at_v"))
    same_h = (F.col("part") < 2) | (F.col("h") == F.col("at_h"))
    return placed.where(same_v & same_h & F.col("key").between(F.col("lo"), F.col("hi"))).drop("d")


def _narrowed(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """The state of each node after its stretch is dealt into bins: the bin that holds the cut, and its rows ``n``."""
    dealt = _inside(rows, state, small).withColumn("bin", F.expr(f"(key - lo) div ((hi - lo) div {BINS} + 1)"))
    bins = dealt.groupBy("node", "bin").agg(
        F.sum("size").alias("w"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"),
    )
    upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))  # at most BINS rows per node
    bins = bins.join(_sent(state.drop("lo", "hi"), small), "node").withColumn("upto", F.col("before") + upto)
    held = bins.where((2 * (F.col("upto") - F.col("w")) < F.col("twice")) & (F.col("twice") <= 2 * F.col("upto")))
    full = (F.col("lo") == F.col("hi")) & (F.col("part") < 2) & (F.col("n") > SORT_ROWS)  # one value: on to the next part
    return held.select(
        "node", "axis", "twice", (F.col("upto") - F.col("w")).alias("before"),
        F.when(full, F.col("part") + 1).otherwise(F.col("part")).alias("part"),
        F.when(full & (F.col("part") == 0), F.col("lo")).otherwise(F.col("at_v")).alias("at_v"),
        F.when(full & (F.col("part") == 1), F.col("lo")).otherwise(F.col("at_h")).alias("at_h"),
        F.when(full, F.lit(0)).otherwise(F.col("lo")).cast("long").alias("lo"),
        F.when(full & (F.col("part") == 0), F.lit(16**HASH_DIGITS)).when(full, F.lit(LAST_ROW)).otherwise(F.col("hi")).cast("long").alias("hi"),
        "n",
    )


def _split(placed: DataFrame, cuts: DataFrame, small: bool) -> DataFrame:
    key = F.struct(F.col("d")[F.col("axis")].alias("v"), F.col("h"), F.col("r"))
    left = (key < F.col("cut")) | (F.col("with_cut") & (key == F.col("cut")))
    half = F.expr("k div 2").cast("int")
    open_, k = F.col("cut").isNotNull(), F.col("k")
    return placed.join(_sent(cuts, small), "node", "left").select(
        "r", "size", "h", "d", F.when(open_ & ~left, F.col("node") + half).otherwise(F.col("node")).alias("node"),
        F.when(~open_, k).when(left, half).otherwise(k - half).alias("k"),
    )
