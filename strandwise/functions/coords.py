"""Chromosome names and PAT spans."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEX_CHROMOSOMES = ("chrX", "chrY")


def normalize_chromosome(name: Column) -> Column:
    """Leading ``chr`` + digits/X/Y/M part, else the name unchanged: chr7_KI27_alt -> chr7."""
    main = F.regexp_extract(name, r"^(chr[0-9XYM]+)", 1)
    return F.when(main != "", main).otherwise(name)


def is_autosome(name: Column, numbered_only: bool = False) -> Column:
    """Not chrX or chrY; with ``numbered_only`` the name must hold ``chr`` followed by a digit."""
    return name.rlike(r"chr\d") if numbered_only else ~name.isin(*SEX_CHROMOSOMES)


def chromosome_key(name: Column) -> Column:
    """What the styles of a chromosome's name share: chr1 and 1, chrM and MT, chrx and X are the same."""
    plain = F.upper(F.regexp_replace(name, r"(?i)^chr(?=.)", ""))
    return F.when(plain == "MT", "M").otherwise(plain)


def is_kept_chromosome(name: Column, drop_sex: bool = True) -> Column:
    """Numbered chromosomes in either style, with X and Y unless ``drop_sex``. Scaffolds named after one count as it."""
    return chromosome_key(name).rlike(r"^\d" if drop_sex else r"^(\d|[XY])")


def called_cpgs(pattern: Column) -> Column:
    """Number of called CpGs (C or T) in a PAT pattern."""
    return F.length(F.regexp_replace(pattern, "[^CT]", ""))


def fragment_end(start: Column, pattern: Column, span: str = "called") -> Column:
    """Last CpG index of a fragment: counting called CpGs only, or every character of the pattern."""
    if span not in ("called", "pattern"):
        raise ValueError(f"span must be 'called' or 'pattern', got {span!r}")
    size = called_cpgs(pattern) if span == "called" else F.length(pattern)
    return start + size - 1
