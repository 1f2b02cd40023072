"""Delimiter and header resolution from the first lines of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwise.session import stage

DELIMITERS = (",", "\t", ";", "|")

# Accepted header names per standard column.
SYNONYMS = {
    "dna_seq": ("dna_seq", "dna_sequence", "sequence", "seq"),
    "methyl_seq": ("methyl_seq", "methyl_sequence", "methylation", "methyl"),
    "ctype": ("ctype", "cell_type", "celltype", "cell"),
    "dmr_label": ("dmr_label", "dmr"),
    "dmr_ctype": ("dmr_ctype", "dmr_cell_type", "dmr_celltype", "dmr_cell"),
    "read_count": ("read_count",),
}


def split_header(line: str, delimiter: str | None = None) -> tuple[str, list[str]]:
    """Delimiter that occurs most often in the header line (unless given), and the header names split by it."""
    delimiter = delimiter or max(DELIMITERS, key=line.count)
    return delimiter, [h.strip().strip('"') for h in line.split(delimiter)]


def split_by_header(spark: SparkSession, lines: DataFrame, path: str) -> list[tuple[str, DataFrame]]:
    """(header line, data lines) for each distinct header among the files of ``numbered_lines``.

    A file's header is its first line that is not blank, wherever that stands; a file without one is an error.
    Different headers are few, one per way the files were written.
    """
    data = lines.where(F.trim("value") != "")
    # line numbers first, so that no text is carried through the aggregation of all lines
    first = stage(lines.groupBy("file").agg(F.min(F.when(F.trim("value") != "", F.col("row_no"))).alias("_head_at")), "header-places")
    blank = first.where(F.col("_head_at").isNull()).select("file").limit(3).collect()
    if blank:
        raise ValueError(f"no header in {', '.join(r['file'] for r in blank)}")
    at = [data["file"] == first["file"], data["row_no"] == first["_head_at"]]
    heads = stage(data.join(first, at).select(first["file"], "_head_at", F.col("value").alias("_head")), "headers")
    distinct = sorted(r[0] for r in heads.select("_head").distinct().collect())
    if not distinct:
        raise ValueError(f"{path} is empty")
    return [
        (h, data.join(heads.where(F.col("_head") == h).drop("_head"), "file").where(F.col("row_no") > F.col("_head_at")))
        for h in distinct
    ]


def resolve_columns(
    headers: list[str], required: tuple[str, ...], optional: tuple[str, ...] = ()
) -> dict[str, str]:
    """Map standard column name -> header.

    The closest kind of match wins: same name, same name without case and underscores, then one
    containing the other. A header serves one standard column only.
    """
    plain = lambda s: s.replace("_", "").lower()
    rules = (
        lambda header, name: header == name,
        lambda header, name: plain(header) == plain(name),
        lambda header, name: plain(name) in plain(header) or plain(header) in plain(name),
    )
    found: dict[str, str] = {}
    for rule in rules:
        for column in (*required, *optional):
            if column in found:
                continue
            for name in SYNONYMS[column]:
                hit = next((h for h in headers if h and h not in found.values() and rule(h, name)), None)
                if hit and not (rule is rules[2] and column in optional):
                    found[column] = hit
                    break
    missing = [c for c in required if c not in found]
    if missing:
        raise ValueError(f"missing columns {missing}; found {headers}")
    return found
