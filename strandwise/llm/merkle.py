"""Merkle manifest of a dataset: every row's digest, and the path of sibling digests up to one root.

Leaves of a group stand in a row by id. An aligned block of 243 of them keeps each level of its tree as one string of
concatenated hex digests: fixed-width substrings are the runs that parents are hashed from, and the substrings left
and right of a node in its run are its siblings. The roots of a group's blocks are the leaves of the next round, until
one is left; the groups' roots are combined in the same way. So no task ever holds more than a block, and paths
are joined block by block, not row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandwise.operators.ordering import rank_globally
from strandwise.session import stage

ARITY = 3  # nodes hashed into one parent
HEIGHT = 5  # levels a block spans
BLOCK = ARITY**HEIGHT
DIGEST = 64  # hex digits of a digest
RUN = ARITY * DIGEST
SENT_GROUPS = 1 << 14  # groups whose paths (about a kilobyte each) are sent to every task

PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
_IN_ORDER = "array_sort(nodes, (a, b) -> CASE WHEN a.pos < b.pos THEN -1 WHEN a.pos > b.pos THEN 1 ELSE 0 END)"


def _parents(level: str) -> str:
    """The level above: each run of a level's digests, hashed."""
    return f"array_join(transform(sequence(0, (length({level}) - 1) div {RUN}), i -> sha2(substring({level}, i * {RUN} + 1, {RUN}), 256)), '')"


def _flanks(level: str, node: str) -> str:
    """Siblings of a level's node: what stands left and right of it in its run."""
    first, own = f"({node}) div {ARITY} * {RUN}", f"({node}) * {DIGEST}"
    return (
        f"named_struct('left', substring({level}, {first} + 1, {own} - {first}), "
        f"'right', substring({level}, {own} + {DIGEST + 1}, {first} + {RUN - DIGEST} - {own}))"
    )


def encoded(value: str | Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = (F.col(f"`{value}`") if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: str | Column) -> Column:
    """The digest of a row: lowercase hex sha256 of its encoded values, concatenated."""
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path: a run's digests are hashed together, level by level."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of the path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def manifest(
    docs: DataFrame, fields: Sequence[str | Column], group: str = "source", doc_id: str = "doc_id",
    out: str = "merkle", keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` columns (by default ``group`` and ``doc_id``) with the struct ``out``: ``leaf, path, subroot, root``.

    ``fields`` make the leaf. Per ``group``, leaves ascend by ``doc_id``; while several nodes remain, every three in a
    row become the digest of their concatenation, and so does a last run of two or one. What is left is the group's
    ``subroot`` (a lone leaf itself). The subroots, ordered by group (null first, by UTF-8 bytes), make the ``root`` likewise.
    ``path`` lists the siblings of each level, from the leaf to the root, as ``left`` and ``right`` hex strings.

    Null groups are one group, null ids come first; rows of one id go by their leaves, and rows with equal leaves too
    are interchangeable. Null and empty texts have leaves of their own. An empty table gives an empty table. A kept column
    called ``out`` is replaced; columns may have any name. Any value of ``group`` may hold any share of the rows.
    Kept columns travel in blocks of 243 rows: a manifest keeps keys, not texts, however long those are.
    """
    names = [c for c in ((group, doc_id) if keep is None else keep) if c != out]
    rows = stage(
        docs.select(
            F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("load"),
            F.col(f"`{group}`").alias("from"), F.col(f"`{doc_id}`").alias("id"), leaf(*fields).alias("digest"),
            F.monotonically_increasing_id().alias("r"),  # tells equal rows apart, so that a sort can part them
        ),
        "merkle-leaves",
    )
    ranked = stage(rank_globally(rows, "from", "id", "digest", "r", rank="place"), "merkle-places")
    groups = ranked.groupBy("from").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    groups = stage(rank_globally(groups, "from", rank="g"), "merkle-groups")
    largest, n_groups = groups.agg(F.max("n"), F.count("*")).first()
    leaves = ranked.join(_sent(groups.withColumnRenamed("from", "of"), n_groups), F.col("from").eqNullSafe(F.col("of"))).select(
        "g", (F.col("place") - F.col("first")).alias("pos"), "n", "digest", "load"
    )
    blocks = _risen(leaves, largest or 0, n_groups)
    subroots = blocks.where("b = 0").select(F.lit(0).cast("long").alias("g"), (F.col("g") - 1).alias("pos"), F.lit(n_groups).alias("n"), F.col("top").alias("digest"), F.lit(None).alias("load"))
    above = _nodes(_risen(subroots, n_groups, 1)).select((F.col("pos") + 1).alias("g"), F.col("path").alias("above"), F.col("top").alias("root"))
    done = _nodes(blocks.join(_sent(stage(above, "merkle-tops"), n_groups), "g"), "root", "above")
    kept = [F.col("load")[f"c{i}"].alias(c) for i, c in enumerate(names)]
    return done.select(
        *kept, F.struct(F.col("digest").alias("leaf"), F.concat("path", "above").alias("path"), F.col("top").alias("subroot"), "root").alias(out)
    )


def _sent(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SENT_GROUPS else table


def _risen(nodes: DataFrame, largest: int, n_groups: int) -> DataFrame:
    """The nodes ``g, pos, n, digest, load`` in blocks ``g, b, nodes, levels``, with the way from the block's root to the
    group's: ``up`` (path) and ``top`` (digest). ``largest`` is the largest ``n``, the nodes of a group."""
    blocks = nodes.groupBy("g", F.expr(f"pos div {BLOCK}").alias("b"), "n").agg(F.collect_list(F.struct("pos", "digest", "load")).alias("nodes"))
    blocks = blocks.withColumn("nodes", F.expr(_IN_ORDER))  # at most a block
    heights = " ".join(f"WHEN n <= {ARITY**h} THEN {h}" for h in range(HEIGHT))
    blocks = blocks.withColumn("levels", F.expr("array(array_join(transform(nodes, x -> x.digest), ''))"))
    blocks = blocks.withColumn("levels", F.expr(
        f"aggregate(array_repeat(0, CASE {heights} ELSE {HEIGHT} END), levels, "
        f"(made, _) -> concat(made, array({_parents('element_at(made, -1)')})))"
    ))
    blocks = stage(blocks.withColumn("top", F.expr("element_at(levels, -1)")), "merkle-blocks")
    no_path = F.array().cast(PATH)
    if largest <= BLOCK:
        return blocks.withColumn("up", no_path)
    roots = blocks.where(F.col("n") > BLOCK).select(
        "g", F.col("b").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("digest"), F.lit(None).alias("load")
    )
    ways = _nodes(_risen(roots, -(-largest // BLOCK), n_groups)).select("g", F.col("pos").alias("b"), F.col("path").alias("up"), F.col("top").alias("higher"))
    return blocks.join(ways, ["g", "b"], "left").select(
        "g", "b", "n", "nodes", "levels", F.coalesce("up", no_path).alias("up"), F.coalesce("higher", "top").alias("top")
    )


def _nodes(blocks: DataFrame, *more: str) -> DataFrame:
    """One row per node of the blocks: ``g, pos, digest, load, path`` (to its group's root), ``top``, and ``more``."""
    rows = blocks.select("g", "levels", "up", "top", *more, F.explode("nodes").alias("node"))
    rows = rows.select("g", "levels", "up", "top", *more, "node.*")
    spans = f"array({', '.join(str(ARITY**h) for h in range(HEIGHT))})"
    # the last level is the block's root alone, which has no siblings inside
    own = f"transform(slice(levels, 1, size(levels) - 1), (level, l) -> {_flanks('level', f'int(pos % {BLOCK}) div {spans}[l]')})"
    return rows.withColumn("path", F.concat(F.expr(own).cast(PATH), "up")).drop("levels", "up")
