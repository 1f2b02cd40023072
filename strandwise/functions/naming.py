"""Sample names, canonical text and cell-type families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Accession and filler that belong to a cell-type name in the sample file names.
SAMPLE_PREFIXES = {
    "Adipocytes": ("GSM5652176_Adipocytes", "-Z000000"),
    "Skeletal-Muscle": ("GSM5652205_Skeletal-Muscle", "-Z00000"),
    "Blood-T": ("GSM5652277_Blood-T-CD3", "-Z000000"),
}
OTHER_PREFIX = "GSM5652XXX_"
SAMPLE_SUFFIX = ".hg38.pat.gz"

# Cell-type sets of the published runs. A type may belong to two sets.
FAMILIES = {
    "Blood": ("Blood-B", "Blood-Granul", "Blood-Mono+Macro", "Blood-NK", "Blood-T", "Eryth-prog"),
    "Blood5": ("Blood-B", "Blood-Granul", "Blood-Mono+Macro", "Blood-NK", "Blood-T"),
    "Structural": ("Adipocytes", "Colon-Fibro", "Endothel", "Heart-Fibro", "Skeletal-Musc", "Smooth-Musc"),
    "Surface": ("Bladder-Ep", "Breast-Basal-Ep", "Breast-Luminal-Ep", "Head-Neck-Ep", "Lung-Ep-Alveo", "Prostate-Ep"),
    "Metabolic": ("Liver-Hep", "Pancreas-Acinar", "Pancreas-Alpha", "Pancreas-Beta", "Pancreas-Delta", "Pancreas-Duct"),
    "Digestive": ("Colon-Ep", "Gastric-Ep", "Lung-Ep-Alveo", "Small-Int-Ep"),
    "Reproductive": ("Fallopian-Ep", "Kidney-Ep", "Ovary-Ep", "Thyroid-Ep"),
    "Excitable": ("Heart-Cardio", "Neuron", "Oligodend"),
    "HLE": ("Breast-Basal-Ep", "Breast-Luminal-Ep", "Fallopian-Ep", "Ovary-Ep", "Prostate-Ep", "Thyroid-Ep"),
}


def canonical(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def matches_any(text: Column, allowed: list[str]) -> Column:
    """The canonical text holds the canonical form of at least one allowed name."""
    names = F.transform(F.array(*[F.lit(a) for a in allowed]), canonical)
    return F.exists(names, lambda a: F.contains(canonical(text), a))


def sample_of_path(path: Column) -> Column:
    """File name without ``.pat`` and ``.gz``. Spark reports paths as URIs, so escapes are decoded; a plus sign is none."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.regexp_extract(plain, r"([^/]+?)(?:\.pat)?(?:\.gz)?$", 1)


def sample_id_from_name(path: Column) -> Column:
    """Sample file name for a per-sample table name such as ``Blood-T-Eff-CD8_41Q_250.csv``.

    The directory, the extension and a trailing ``_250`` go; the last ``_`` part identifies the
    sample and the rest is the cell type. Null when there is no ``_`` part to use.
    """
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    parts = F.split(base, "_")
    trimmed = F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "250"), F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)
    ident = F.element_at(trimmed, -1)
    ctype = F.array_join(F.slice(trimmed, F.lit(1), F.size(trimmed) - 1), "_")
    head = F.concat(F.lit(OTHER_PREFIX), F.translate(ctype, "_", "-"), F.lit("-Z000000"))
    for name, (prefix, filler) in SAMPLE_PREFIXES.items():
        head = F.when(ctype == name, F.lit(prefix + filler)).otherwise(head)
    return F.when(F.size(trimmed) >= 2, F.concat(head, ident, F.lit(SAMPLE_SUFFIX)))


def family_table(spark: SparkSession, families: dict[str, tuple[str, ...]] = FAMILIES) -> DataFrame:
    """Grouping scheme as a small table (ctype, family)."""
    rows = [(ctype, family) for family, members in families.items() for ctype in members]
    return spark.createDataFrame(rows, "ctype string, family string")


def assign_family(reads: DataFrame, scheme: DataFrame) -> DataFrame:
    """Reads with their family; a type in two families gives two rows, one in none is dropped."""
    return reads.join(scheme, "ctype")


def explode_composite(reads: DataFrame, column: str = "dmr_ctype", member: str = "dmr_member") -> DataFrame:
    """One row per member of a colon-joined region type."""
    return reads.withColumn(member, F.explode(F.split(F.col(column), ":")))
