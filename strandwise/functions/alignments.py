"""Methylation calls of aligned reads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strandwise.functions.keys import as_col, let
from strandwise.functions.reads import window_text

DUPLICATE, PAIRED, REVERSE, FIRST = 1024, 1, 16, 64
METHYLATED_FROM = 178  # summed 0..255 likelihoods of both modifications
FAILED = "!"  # stands for a non-CpG call inside a CpG


def project_on_reference(calls: Column, cigar: Column) -> Column:
    """Per-base calls of the query laid out along the reference.

    Soft clips and insertions use up calls and go; deletions and skipped stretches are D without using
    any; hard clips and padding do neither.
    """
    sizes = F.regexp_extract_all(cigar, F.lit(r"(\d+)[A-Z=]"), F.lit(1))
    kinds = F.regexp_extract_all(cigar, F.lit(r"\d+([A-Z=])"), F.lit(1))
    steps = F.zip_with(sizes, kinds, lambda n, k: F.struct(n.cast("int").alias("n"), k.alias("k")))

    def step(acc: Column, s: Column) -> Column:
        n, kind = s["n"], s["k"]
        kept = F.when(kind.isin("D", "N"), F.repeat(F.lit("D"), n)).when(kind.isin("S", "I", "H", "P"), "").otherwise(
            F.substring(calls, acc["at"] + 1, n)
        )
        return F.struct(
            F.concat(acc["text"], kept).alias("text"), F.when(kind.isin("D", "N", "H", "P"), acc["at"]).otherwise(acc["at"] + n).alias("at")
        )

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    return F.aggregate(steps, start, step, lambda acc: acc["text"])


def _cigar_length(cigar: Column, kinds: str) -> Column:
    sizes = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda total, n: total + n.cast("long"))


def reference_length(cigar: Column) -> Column:
    """Reference bases an alignment spans: matches, mismatches, deletions and skipped stretches."""
    return _cigar_length(cigar, "MDN=X")


def query_length(cigar: Column) -> Column:
    """Bases of the read that are aligned or inserted, without clips."""
    return _cigar_length(cigar, "MI=X")


def decode_bismark(ref: Column | str, xm: Column | str, cigar: Column | str, flag: Column | str) -> Column:
    """struct(bases, failed): reference bases with z / Z at called CpGs.

    Duplicates, reads without a CpG call and references without a CG give null bases. A missing or
    deleted call counts as C. A non-CpG call inside a CpG sets ``failed`` instead of ending the job.
    """
    ref, xm, cigar, flag = (as_col(c) for c in (ref, xm, cigar, flag))
    bit = lambda b: flag.bitwiseAND(b) != 0
    top = F.when(bit(PAIRED), bit(REVERSE) != bit(FIRST)).otherwise(~bit(REVERSE))

    def spelled(calls: Column) -> Column:
        def base(i: Column) -> Column:
            # the call of a bottom-strand read sits on the G
            at = F.when(top | (i > F.length(calls)), i).otherwise(i + 1)
            call = F.when(at <= F.length(calls), F.substring(calls, at, F.lit(1))).otherwise(".")
            shown = let(
                call,
                lambda c: F.when(c.isin(".", "D"), "C")
                .when(c.isin("x", "h", "X", "H"), F.when(F.contains(F.substring(calls, i, F.lit(2)), F.lit("D")), "C").otherwise(FAILED))
                .otherwise(c),
            )
            return F.when(F.substring(ref, i, F.lit(2)) == "CG", shown).otherwise(F.substring(ref, i, F.lit(1)))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(ref)), base), "")

    usable = ~bit(DUPLICATE) & xm.rlike("[zZ]") & F.contains(ref, F.lit("CG"))
    text = F.when(usable, let(project_on_reference(xm, cigar), spelled))
    return let(
        text,
        lambda t: F.struct(
            F.when(~F.contains(t, F.lit(FAILED)), t).alias("bases"),
            F.coalesce(F.contains(t, F.lit(FAILED)), F.lit(False)).alias("failed"),
        ),
    )


def decoded_kmers(bases: Column, k: int = 3) -> tuple[Column, Column]:
    """3-mers and methylation string of decoded bases; the final window is left out."""
    plain = F.translate(bases, "hHzZxX", "CCCCCC")
    windows = F.length(bases) - k
    dna = window_text(plain, k, windows)
    middles = F.substring(bases, F.lit(1 + k // 2), windows)
    methyl = F.translate(F.regexp_replace(middles, "(?s)[^zZ]", "2"), "zZ", "01")
    return F.when(windows >= 1, dna).otherwise(""), F.when(windows >= 1, methyl).otherwise("")


def call_longread(positions: Column, hydroxy: Column, methyl: Column, cigar: Column, reverse: Column) -> Column:
    """Array of struct(pos, call) for long reads with 0..255 likelihood arrays per modified base.

    A missing channel counts as 0 and hard-clipped reads give null. On the reverse strand the call
    moves to the C, one base before the listed G.
    """
    both = F.coalesce(F.greatest(F.size(hydroxy), F.size(methyl)), F.lit(0))
    value = lambda channel, i: F.coalesce(F.get(channel, i), F.lit(0)).cast("int")
    shift = F.when(reverse, F.lit(1)).otherwise(F.lit(0))
    calls = F.transform(
        positions,
        lambda p, i: F.struct(
            (p - shift).alias("pos"),
            (value(hydroxy, i) + value(methyl, i) >= METHYLATED_FROM).cast("int").alias("call"),
        ),
    )
    return F.when(~F.contains(cigar, F.lit("H")) & (both > 0), calls)
