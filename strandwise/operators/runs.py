"""Evaluation curves of training runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strandwise.operators.ordering import running
from strandwise.session import stage

NO_POINT = -(1 << 62)
BLOCK_GAPS = 4096  # a block spans this many gaps
BLOCKS = 1024  # blocks per super-block


def run_summary(curve: DataFrame) -> DataFrame:
    """Per run the lowest-loss ("final") and the highest-accuracy ("best") step, earliest among equals."""
    return curve.groupBy("run").agg(
        F.count("*").alias("n_points"),
        F.min_by("step", F.struct("loss", "step")).alias("final_step"), F.min("loss").alias("final_loss"),
        F.min_by("acc", F.struct("loss", "step")).alias("final_acc"),
        F.min_by("step", F.struct(-F.col("acc"), F.col("step"))).alias("best_step"), F.max("acc").alias("best_acc"),
    )


def improvements(curve: DataFrame, value: str = "loss") -> DataFrame:
    """Points whose loss is strictly below every earlier one of their run."""
    seen = running(curve, ["run"], "step", value, "_best", how="min")
    return seen.where(F.col("_best").isNull() | (F.col(value) < F.col("_best"))).drop("_best")


SUMMARY = "run string, super bigint, block bigint, starts array<bigint>, ends array<bigint>"


def _entered(blocks: Column, wanted: Column, gap: int) -> Column:
    """The step wanted after the blocks, entered looking for a step >= ``wanted``. A block without one changes nothing."""

    def through(asked: Column, block: Column) -> Column:
        hit = F.get(F.filter(block["jumps"], lambda j: j["start"] >= asked), F.lit(0))
        return F.coalesce(hit["end"] + gap, asked)

    return F.aggregate(blocks, wanted, through)


def _each_entry(blocks: Column, wanted: Column, gap: int) -> Column:
    """``at, wanted`` for each block: what it is entered with."""
    start = F.struct(wanted.alias("wanted"), F.array().cast("array<struct<at: bigint, wanted: bigint>>").alias("seen"))

    def through(state: Column, block: Column) -> Column:
        seen = F.concat(state["seen"], F.array(F.struct(block["at"].alias("at"), state["wanted"].alias("wanted"))))
        return F.struct(_entered(F.array(block), state["wanted"], gap).alias("wanted"), seen.alias("seen"))

    return F.aggregate(blocks, start, through, lambda state: state["seen"])


def _in_order(at: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "jumps"))).alias("blocks")


def thin_curve(curve: DataFrame, gap: int = 1000, block_gaps: int = BLOCK_GAPS, blocks: int = BLOCKS) -> DataFrame:
    """Keep each run's first point, then each point at least ``gap`` steps after the last kept, and the last.

    The rule is sequential, so it is run as a scan over blocks of steps. A block becomes a jump table: for each place it
    can be entered (only its first ``gap`` steps matter) where it would be left, with neighbours that are left at the same
    step merged. Tables compose: those of a super-block make one of the same shape, and super-blocks are walked per run, as
    expressions over arrays. The entries found that way let every block pick its points independently. Steps are whole
    numbers, distinct within a run.
    """
    width = gap * block_gaps
    points = curve.select("run", F.col("step").cast("long").alias("step")).distinct()
    points = points.withColumn("block", F.floor(F.col("step") / width)).withColumn("super", F.floor(F.col("block") / blocks))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        step = np.sort(pdf["step"].to_numpy())
        follow = np.searchsorted(step, step + gap)
        last = step.copy()
        for i in range(len(step) - 1, -1, -1):
            if follow[i] < len(step):
                last[i] = last[follow[i]]
        # a predecessor lies before the block, so it asks for a step within the first gap of the block
        n = min(int(np.searchsorted(step, int(pdf["block"].iloc[0]) * width + gap)) + 1, len(step))
        shown = np.flatnonzero(np.append(last[1:n] != last[: n - 1], True))
        names = {c: pdf[c].iloc[:1].tolist() for c in ("run", "super", "block")}
        return pd.DataFrame({**names, "starts": [step[shown].tolist()], "ends": [last[shown].tolist()]})

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        step = np.sort(pdf["step"].to_numpy())
        i, kept = int(np.searchsorted(step, pdf["wanted"].iloc[0])), []
        while i < len(step):
            kept.append(int(step[i]))
            i = int(np.searchsorted(step, step[i] + gap))
        return pd.DataFrame({"run": pdf["run"].iloc[0], "step": kept}, columns=["run", "step"]) if kept else pd.DataFrame(
            {"run": pd.Series(dtype=str), "step": pd.Series(dtype="int64")})

    table = F.zip_with("starts", "ends", lambda start, end: F.struct(start.alias("start"), end.alias("end"))).alias("jumps")
    summaries = points.groupBy("run", "super", "block").applyInPandas(summarise, SUMMARY)
    by_block = stage(summaries.select("run", "super", "block", table), "blocks")
    grouped = by_block.groupBy("run", "super").agg(_in_order("block"))  # at most `blocks` tables
    # a predecessor can only ask for the head of the first block, or else for the next block's first point
    entries = F.concat(F.col("blocks")[0]["jumps"]["start"], F.slice(F.coalesce(F.get("blocks", F.lit(1))["jumps"]["start"], F.array().cast("array<bigint>")), 1, 1))
    jumps = F.transform(entries, lambda s: F.struct(s.alias("start"), (_entered(F.col("blocks"), s, gap) - gap).alias("end")))
    supers = grouped.select("run", "super", "blocks", jumps.alias("jumps"))
    chained = stage(supers, "super-blocks")
    walked = chained.groupBy("run").agg(_in_order("super")).select("run", F.inline(_each_entry(F.col("blocks"), F.lit(NO_POINT).cast("long"), gap)))
    entered = chained.join(walked.withColumnRenamed("at", "super"), ["run", "super"])
    found = entered.select("run", F.inline(_each_entry(F.col("blocks"), F.col("wanted"), gap)))
    kept = points.join(stage(found.withColumnRenamed("at", "block"), "entries"), ["run", "block"])
    kept = kept.groupBy("run", "block").applyInPandas(pick, "run string, step bigint")
    last = curve.groupBy("run").agg(F.max("step").cast("long").alias("step"))
    return curve.join(kept.unionByName(last).distinct(), ["run", "step"])


__all__ = ["improvements", "run_summary", "thin_curve"]
