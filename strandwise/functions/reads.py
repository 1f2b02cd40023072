"""Column expressions over DNA, PAT patterns and methylation strings."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from strandwise.functions.keys import let

FLANK = 10  # bases of context kept on each side of the covered CpGs
BLOCK = 16  # windows spelled by one match
LISTED = 2048  # lengths beyond the longest piece whose halves are listed in the plan


def clean_bases(seq: Column) -> Column:
    """Upper case, anything but A C G T becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def kmer_array(seq: Column, k: int = 3, drop_last: bool = False) -> Column:
    """All overlapping k-mers of a cleaned sequence; ``drop_last`` leaves out the final window."""
    lost = k if drop_last else k - 1

    def windows(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(s) - lost), lambda i: F.substring(s, i, F.lit(k)))

    return F.when(F.length(seq) > lost, let(clean_bases(seq), windows)).otherwise(F.array().cast("array<string>"))


def window_text(text: Column, k: int, windows: Column) -> Column:
    """The first ``windows`` (at least one) overlapping windows of ``k`` characters, joined by spaces.

    One pattern spells a block of windows at a time, without a list of them. Filling after the text completes the last block.
    """
    spots = "(.)" * BLOCK + ("(?=" + "(.)" * (k - 1) + ")" if k > 1 else "")
    spelled = "".join("".join(f"${at + i}" for i in range(k)) + " " for at in range(1, BLOCK + 1))
    filled = F.concat(text, F.lit("N" * (BLOCK - 1)))
    return F.substring(F.regexp_replace(filled, f"(?s){spots}", spelled), F.lit(1), (windows * (k + 1) - 1).cast("int"))


def kmers(seq: Column, k: int = 3, drop_last: bool = False) -> Column:
    """Space-joined k-mers; empty text for sequences that are too short."""
    lost = k if drop_last else k - 1
    # cleaning keeps the number of characters of the upper-case text
    return F.when(F.length(seq) > lost, window_text(clean_bases(seq), k, F.length(F.upper(seq)) - lost)).otherwise("")


def impute_missing(pattern: Column) -> Column:
    """Fill ``.`` with the last called value; a leading gap takes the first called value.

    The pattern is cut into runs of one call and the gap after it, each run becomes its call
    repeated, and the leading gap repeats the first character. All-missing patterns stay.
    """
    gap = F.length(F.regexp_extract(pattern, r"^(\.*)", 1))
    first = F.substring(pattern, gap + 1, F.lit(1))
    runs = F.regexp_extract_all(pattern, F.lit(r"[CT]\.*"), F.lit(0))
    filled = F.transform(runs, lambda r: F.repeat(F.left(r, F.lit(1)), F.length(r)))
    return (
        F.when(~F.contains(pattern, F.lit(".")) | ~pattern.rlike("[CT]"), pattern)
        .otherwise(F.concat(F.repeat(first, gap), F.array_join(filled, "")))
    )


def n_cpg(methyl: Column) -> Column:
    """Number of called CpGs in a methylation string."""
    return F.length(F.regexp_replace(methyl, "[^01]", "")).cast("long")


def is_informative(methyl: Column) -> Column:
    """At least one called CpG."""
    return methyl.rlike("[01]")


def read_weight(count: Column) -> Column:
    """A read count that is usable as weight: unparsable or missing counts as 1."""
    return F.coalesce(count.try_cast("int"), F.lit(1))


def context_span(seq: Column, first_c: Column, last_g: Column, flank: int = FLANK) -> tuple[Column, Column]:
    """0-based offsets in ``seq`` of the first and last base kept around the covered CpGs.

    Going left from the first C at most ``flank`` bases are added, stopping before another CG.
    Going right from the last G likewise, stopping on the C of another CG and before the last base.
    """
    low = F.greatest(first_c - flank, F.lit(0))
    left = F.substring(seq, low + 1, first_c - low)
    hit = F.locate("GC", F.reverse(left))
    start = F.when(hit > 0, first_c - hit).otherwise(low)
    high = F.greatest(F.least(last_g + flank, F.length(seq) - 2), last_g)
    right = F.substring(seq, last_g + 2, high - last_g)
    stop = F.locate("CG", right)
    end = F.when(stop > 0, last_g + stop).otherwise(high)
    return start, end


def methyl_string(cpgs: Column, origin: Column, tokens: Column) -> Column:
    """One character per 3-mer: the state at each covered CpG, 2 elsewhere.

    ``cpgs`` is an array of struct(pos, state) in order, ``origin`` the position of the first base.
    The 3-mer that shows the C of a CpG in its middle starts one base before it, so a CpG on the
    very first base has no 3-mer.
    """
    start = F.struct(F.lit("").alias("text"), origin.cast("long").alias("at"))
    drawn = F.aggregate(
        F.filter(cpgs, lambda c: c["pos"] > origin),
        start,
        lambda acc, c: F.struct(
            F.concat(acc["text"], F.repeat(F.lit("2"), (c["pos"] - acc["at"] - 1).cast("int")), c["state"]).alias("text"),
            c["pos"].cast("long").alias("at"),
        ),
        lambda acc: acc["text"],
    )
    return F.rpad(drawn, tokens, "2")


def half_spans(length: Column, longest: int) -> Column:
    """Pieces left by halving until none is longer than ``longest``, in order: struct(at, n) with a 0-based start.

    Lengths up to eight times ``longest`` (``LISTED`` of them at most) are looked up in a list. For others, every round
    replaces a piece that is still too long by ``n div 2`` and the rest; log2 of the length over ``longest`` rounds are
    enough, one more covers the uneven halves.
    """
    if longest < 1:
        raise ValueError("longest must be positive")

    def halves(at: int, n: int) -> list[dict[str, int]]:
        return [{"at": at, "n": n}] if n <= longest else halves(at, n // 2) + halves(at + n // 2, n - n // 2)

    top = min(8 * longest, longest + LISTED)
    listed = F.from_json(F.lit(json.dumps([halves(0, n) for n in range(longest + 1, top + 1)])), "array<array<struct<at:int,n:int>>>")

    def piece(at: Column, n: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"))

    def halve(pieces: Column) -> Column:
        def cut(p: Column) -> Column:
            half = F.call_function("div", p["n"], F.lit(2))
            return F.when(p["n"] > longest, F.array(piece(p["at"], half), piece(p["at"] + half, p["n"] - half))).otherwise(F.array(p))

        return F.flatten(F.transform(pieces, cut))

    rounds = F.ceil(F.log2(length / F.lit(float(longest))) + 1e-9).cast("int") + 1
    whole = F.array(piece(F.lit(0), length))
    return F.when(length <= longest, whole).when(length <= top, F.get(listed, (length - longest - 1).cast("int"))).otherwise(
        F.aggregate(F.sequence(F.lit(1), rounds), whole, lambda pieces, _: halve(pieces))
    )


def half_lengths(length: Column, longest: int) -> Column:
    """Piece lengths left by halving until no piece is longer than ``longest``, in order."""
    return F.transform(half_spans(length, longest), lambda p: p["n"])
