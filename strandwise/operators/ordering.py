"""Ranks and prefix cuts of very large groups.

A window over a whole cell type would sort all its rows in one task. The helpers here first count
rows per (group, slice of the order); only the slice that holds the cut, or each slice by itself,
is ever sorted, so the largest sort shrinks by the number of slices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwise.session import stage

DIGITS = 3  # hex digits of the order key per round: each round cuts a slice into 4,096
ROUNDS = 3
SORT_ROWS = 1_000_000  # rows of one slice that may be sorted together
AFTER_ALL = "g"  # sorts after every hex key


def prefix_cuts(
    items: DataFrame,
    groups: Sequence[str],
    key: str,
    target: Callable[[Column], Column] | DataFrame,
    weight: Column | None = None,
    nearest: bool = False,
    sort_rows: int = SORT_ROWS,
) -> DataFrame:
    """Per group, the last order key of the longest prefix whose weight stays within the target.

    ``target`` maps a group's total weight to its limit, or is a table ``groups + target``.
    Rows sharing ``key`` are one item and stay together. With ``nearest`` the item that crosses the
    limit is taken too when at least half of it lies below the limit. Returns ``groups + cut``; an
    item belongs to the prefix when ``key <= cut``.

    The slice of the order in which the limit falls is narrowed until it is small enough to sort.
    """
    names = list(groups) or ["_all"]
    slim = items if groups else items.withColumn("_all", F.lit(0))
    slim = slim.select(*names, F.col(key).alias("_key"), (F.lit(1) if weight is None else weight).cast("long").alias("_weight"))
    whole = Window.partitionBy(*names)  # one row per slice of a group
    upto = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slice_of = lambda digits: F.substring("_key", 1, digits).alias("_slice")

    slices = slim.groupBy(*names, slice_of(DIGITS)).agg(F.sum("_weight").alias("_size"), F.count("*").alias("_rows"))
    slices = slices.select("*", F.sum("_size").over(upto).alias("_upto"))
    if isinstance(target, DataFrame):
        slices = slices.join(target.withColumnRenamed("target", "_target"), names)
    else:
        slices = slices.withColumn("_target", target(F.sum("_size").over(whole)).cast("long"))

    def crossed(table: DataFrame) -> DataFrame:
        """The slice of each group that holds the limit, null when the limit is not reached."""
        hit = (F.col("_upto") > F.col("_target")) & (F.col("_upto") - F.col("_size") <= F.col("_target"))
        pick = lambda c: F.max(F.when(hit, c))
        return stage(
            table.groupBy(*names).agg(
                pick(F.col("_slice")).alias("_slice"), pick(F.col("_upto") - F.col("_size")).alias("_before"),
                pick(F.col("_rows")).alias("_rows"), F.max("_target").alias("_target"),
            ),
            "edges",
        )

    edges, digits = crossed(slices), DIGITS
    for _ in range(1, ROUNDS):
        if (edges.agg(F.max("_rows")).first()[0] or 0) <= sort_rows:
            break
        open_edges = edges.select(*names, "_slice", "_before", "_target").where(F.col("_slice").isNotNull())
        finer = (
            slim.withColumn("_slice", slice_of(digits)).join(open_edges, [*names, "_slice"])
            .groupBy(*names, slice_of(digits + DIGITS))
            .agg(F.sum("_weight").alias("_size"), F.count("*").alias("_rows"), F.max("_before").alias("_b"), F.max("_target").alias("_target"))
            .withColumn("_upto", F.sum("_size").over(upto) + F.col("_b"))
        )
        rest = edges.where(F.col("_slice").isNull())
        edges = crossed(finer).unionByName(rest)
        digits += DIGITS
    run = whole.orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (
        slim.withColumn("_slice", slice_of(digits))
        .join(edges.drop("_rows").where(F.col("_slice").isNotNull()), [*names, "_slice"])
        .groupBy(*names, "_key")
        .agg(F.sum("_weight").alias("_w"), F.max("_before").alias("_before"), F.max("_target").alias("_target"))
        .withColumn("_run", F.sum("_w").over(run) + F.col("_before"))
    )
    if nearest:
        taken = 2 * F.col("_run") - F.col("_w") <= 2 * F.col("_target")
    else:
        taken = F.col("_run") <= F.col("_target")
    last = inside.where(taken).groupBy(*names).agg(F.max("_key").alias("_last"))
    cuts = edges.join(last, names, "left").select(
        *names,
        # nothing of the slice taken: cut just before it
        F.when(F.col("_slice").isNull(), F.lit(AFTER_ALL)).otherwise(F.coalesce("_last", "_slice")).alias("cut"),
    )
    return stage(cuts if groups else cuts.drop("_all"), "cuts")


def flag_prefix(rows: DataFrame, cuts: DataFrame, groups: Sequence[str], key: str, flag: str) -> DataFrame:
    """Add a boolean ``flag``: does the row's order key lie in its group's prefix?"""
    if groups:
        joined = rows.join(cuts, list(groups))
    else:
        limit = cuts.first()
        joined = rows.withColumn("cut", F.lit(limit["cut"] if limit else AFTER_ALL))
    return joined.withColumn(flag, F.col(key) <= F.col("cut")).drop("cut")


def rank_in_group(
    rows: DataFrame, groups: Sequence[str], key: str, rank: str = "rank", sort_rows: int = SORT_ROWS, largest: int | None = None
) -> DataFrame:
    """1-based rank of each row by ``key`` inside its group; sorts one slice at a time.

    The number of slices follows from the size of the largest group (counted when not given), so that
    none holds much more than ``sort_rows`` rows.
    """
    names = list(groups)
    if largest is None:
        largest = rows.groupBy(*names).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    digits = next(d for d in range(1, 9) if largest / 16**d <= sort_rows / 4 or d == 8)
    sliced = rows.withColumn("_slice", F.substring(F.col(key), 1, digits))
    before = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        sliced.groupBy(*names, "_slice")
        .agg(F.count("*").alias("_n"))
        .select(*names, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")),
        "offsets",
    )
    inside = Window.partitionBy(*names, "_slice").orderBy(key)
    return (
        sliced.join(offsets, [*names, "_slice"])
        .withColumn(rank, F.col("_offset") + F.row_number().over(inside))
        .drop("_slice", "_offset")
    )


def rank_positions(
    points: DataFrame, group: str, position: str, rank: str = "rank", span: int = 1 << 18
) -> DataFrame:
    """1-based rank over (group, position) of distinct positions; a slice holds at most ``span`` rows."""
    sliced = points.withColumn("_slice", F.expr(f"`{position}` div {int(span)}"))
    counts = sliced.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    # one row per slice of `span` positions, so this ordering is of a small table
    before = Window.orderBy(group, "_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        counts.select(group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")),
        "offsets",
    )
    inside = Window.partitionBy(group, "_slice").orderBy(position)
    return (
        sliced.join(offsets, [group, "_slice"])
        .withColumn(rank, F.col("_offset") + F.row_number().over(inside))
        .drop("_slice", "_offset")
    )


def rank_globally(rows: DataFrame, *order: Column | str, rank: str = "rank") -> DataFrame:
    """1-based rank over the whole table by a distributed sort; ``order`` must tell rows apart.

    The sorted rows are written with their partition and place. One count per partition turns the
    place into a rank.
    """
    placed = stage(
        rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}),
        "sorted",
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = stage(
        placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
        .select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")),
        "offsets",
    )
    return (
        placed.join(offsets, "_part")
        .withColumn(rank, F.col("_offset") + F.col("_place") - F.col("_first") + 1)
        .drop("_part", "_place", "_first", "_offset")
    )


def running(
    rows: DataFrame,
    groups: Sequence[str],
    position: str,
    value: str,
    name: str,
    how: str = "sum",
    inclusive: bool = False,
    span: int = 1 << 18,
) -> DataFrame:
    """Running sum, min or last non-null of ``value`` by ``position``, per group.

    Positions are whole numbers, distinct within a group. Each stretch of ``span`` positions is
    aggregated on its own, the results are carried forward in a table with one row per stretch, and only
    inside a stretch rows are sorted, so a sort never holds more than ``span`` rows.
    """
    names = list(groups)
    if how == "sum":
        total, over, join = F.sum(value), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    elif how == "min":
        total, over, join = F.min(value), F.min, lambda a, b: F.least(a, b)  # least() skips nulls
    elif how == "last":
        total = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position)))
        over, join = (lambda c: F.last(c, ignorenulls=True)), lambda a, b: F.coalesce(b, a)
    else:
        raise ValueError(f"how must be 'sum', 'min' or 'last', got {how!r}")
    binned = rows.withColumn("_bin", F.expr(f"`{position}` div {int(span)}"))
    earlier = Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = stage(
        binned.groupBy(*names, "_bin").agg(total.alias("_t")).select(*names, "_bin", over("_t").over(earlier).alias("_carried")),
        "carried",
    )
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*names, "_bin").orderBy(position).rowsBetween(Window.unboundedPreceding, end)
    return (
        binned.join(carried, [*names, "_bin"])
        .withColumn(name, join(F.col("_carried"), over(value).over(inside)))
        .drop("_bin", "_carried")
    )
