"""Cutting long reads into pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwise.functions.reads import half_spans

TRIPLES = r"^[^ ]{3}( [^ ]{3})*\z"


def split_long(reads: DataFrame, longest: int = 250) -> DataFrame:
    """Reads longer than ``longest`` halved until every piece fits, 3-mers and calls together.

    Adds ``piece`` (0-based). The halves of a read are its consecutive stretches, listed once from its length. Where every
    token has three letters, a piece starts at a known letter; other reads are split into tokens first, once each.
    """
    cut = F.length("methyl_seq") > longest
    even = F.col("dna_seq").rlike(TRIPLES)
    tokens = F.when(cut & ~F.coalesce(even, F.lit(False)), F.split("dna_seq", " "))
    others = [c for c in reads.columns if c not in ("dna_seq", "methyl_seq")]
    spread = reads.select("*", cut.alias("_cut"), tokens.alias("_tokens")).select(
        *others, "dna_seq", "methyl_seq", "_cut", "_tokens", F.posexplode(half_spans(F.length("methyl_seq"), longest)).alias("piece", "_p"),
    )
    at, n = F.col("_p.at"), F.col("_p.n")
    dna = (
        F.when(~F.col("_cut"), F.col("dna_seq"))
        .when(F.col("_tokens").isNotNull(), F.array_join(F.slice("_tokens", at + 1, n), " "))
        .otherwise(F.substring("dna_seq", at * 4 + 1, n * 4 - 1))
    )
    parts = {"dna_seq": dna, "methyl_seq": F.when(F.col("_cut"), F.substring("methyl_seq", at + 1, n)).otherwise(F.col("methyl_seq"))}
    return spread.select(*[parts[c].alias(c) if c in parts else F.col(c) for c in reads.columns], "piece")
