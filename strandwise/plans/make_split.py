"""From per-sample reads to training tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from strandwise.functions.pieces import split_long
from strandwise.operators import splitting as S
from strandwise.operators.balancing import balance_on_target
from strandwise.operators.combine import keep_known_region_types
from strandwise.operators.dedup import expand_counts
from strandwise.operators.selection import filter_length
from strandwise.session import stage

def _three_way(rows: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), by: str = "name", **how) -> DataFrame:
    return S.split_train_valid_test(rows, ratios, by, **how)


MODES: dict[str, Callable[..., DataFrame]] = {
    "random": S.split_random,
    "stratified": S.split_stratified,
    "sample": S.split_by_sample,
    "sequence": S.split_by_sequence,
    "dedup": S.dedup_then_split,
    "dedup_cross_sample": S.dedup_cross_sample_split,
    "dedup_shared": S.dedup_shared_split,
    "manual": S.split_manual,
    "three_way": _three_way,
}


TRAINING = ("dna_seq", "methyl_seq", "ctype", "dmr_label")
EXTRA = ("dmr_ctype", "read_count")


def make_split(
    reads: DataFrame, mode: str = "sample", balance: bool = False, shortest: int = 25, longest: int = 250,
    expand: bool = False, extra: Sequence[str] = EXTRA, **how,
) -> DataFrame:
    """Known region types only, optionally balanced, split, repeated by count and cut to length.

    What comes before the split works on whole reads, so copies and pieces of a read stay on its side. ``expand`` repeats
    each read by its count, unusable counts giving one. Short reads go before halving, so a half may be shorter than
    ``shortest``. Returns the training columns, the ``extra`` ones that the reads have, ``piece`` (0-based) and ``side``.
    ``three_way`` splits names (``by``) into train, valid and test; the other modes know two sides.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}, got {mode!r}")
    rows = keep_known_region_types(reads)
    if balance:
        rows = stage(balance_on_target(rows), "balanced")
    sides = filter_length(MODES[mode](rows, **how), shortest)
    if expand:
        sides = expand_counts(sides)
    kept = [c for c in extra if c in reads.columns and c not in TRAINING]
    return split_long(sides.select(*TRAINING, *kept, "side"), longest).select(*TRAINING, *kept, "piece", "side")
