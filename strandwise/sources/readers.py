"""Readers: every one returns a DataFrame with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandwise.functions import coords
from strandwise.functions.naming import sample_of_path
from strandwise.operators.intervals import attach_cpg_range, require_cpgs
from strandwise.operators.joins import dealt
from strandwise.operators.ordering import running
from strandwise.sources.headers import resolve_columns, split_by_header, split_header
from strandwise.session import stage
from strandwise.sources.lines import fill_from_marker, numbered_lines

PAT_SCHEMA = "chr string, cpg_start bigint, pattern string, read_count int"
CPG_SCHEMA = "chr string, pos bigint, cpg_idx bigint"
MANIFEST_ENTRY = "pat_file string, output_file string, cell_type string, csv_file string, fasta_file string, cpg_bed_file string"
READ_COLUMNS = ("dna_seq", "methyl_seq", "dmr_label", "ctype", "dmr_ctype", "read_count")
SECTION_SUFFIX = ".pat.gz"
UNSPLITTABLE = (".gz", ".zst", ".snappy", ".lz4")
GENOME_CHUNK = 1024


def read_fragments(spark: SparkSession, path: str | list[str], span: str = "called") -> DataFrame:
    """PAT text files as fragments; the file name is the sample.

    Short lines and patterns without a call are skipped. ``span`` says whether ``cpg_end`` counts
    called CpGs only or every character. A gz file is read by one task, which deals its rows out to all
    partitions before anything else is done with them, whatever its size.
    """
    raw = spark.read.schema(PAT_SCHEMA).csv(path, sep="\t")
    name = sample_of_path(F.col("_metadata.file_path"))
    named = raw.select(name.alias("sample_id"), "*")
    unsplittable = any(f.endswith(UNSPLITTABLE) for f in raw.inputFiles())
    return clean_fragments(dealt(named) if unsplittable else named, span)


def clean_fragments(raw: DataFrame, span: str = "called") -> DataFrame:
    """Drop unusable rows and add ``cpg_end``; shared by the batch and the streaming reader."""
    return raw.where(
        F.col("cpg_start").isNotNull() & F.col("read_count").isNotNull() & F.col("pattern").rlike("[CT]")
    ).withColumn("cpg_end", coords.fragment_end(F.col("cpg_start"), F.col("pattern"), span))


def read_cpg_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CpG index, clustered by chromosome and position."""
    raw = spark.read.schema(CPG_SCHEMA).csv(path, sep="\t", comment="#")
    return raw.where(F.col("pos").isNotNull() & F.col("cpg_idx").isNotNull()).sortWithinPartitions("chr", "pos")


def read_regions(
    spark: SparkSession,
    path: str,
    cpg: DataFrame | None = None,
    target_type: str | None = None,
    drop_sex: bool = True,
    type_columns: tuple[str, ...] = ("cell_type", "Type", "DMR_cType"),
) -> DataFrame:
    """Marker regions from CSV; ``dmr_label`` is the data row number before any filtering.

    Several files count on in the order of their names, each with its own header row, which may name its
    columns in an order of its own.
    """
    lines = numbered_lines(spark, path)
    # one row per file
    earlier = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = stage(
        lines.groupBy("file").agg(F.max("row_no").alias("_n"))
        .select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")),
        "files",
    )

    def parsed(header: str, rows: DataFrame) -> DataFrame:
        _, headers = split_header(header, ",")
        has_cpg = {"startCpG", "endCpG"} <= set(headers)
        if cpg is None and not has_cpg:
            raise ValueError("regions need startCpG and endCpG columns or a CpG index")
        schema = ", ".join(f"`{h}` string" for h in headers)
        row = rows.join(files, "file").select(
            (F.col("_before") + F.col("row_no") - 1).alias("dmr_label"), F.from_csv("value", schema).alias("r")
        )
        type_column = next((c for c in type_columns if c in headers), None)
        found = row.select(
            "dmr_label",
            coords.normalize_chromosome(F.col("r.chr")).alias("chr"),
            F.col("r.start").cast("bigint").alias("start"),
            F.col("r.end").cast("bigint").alias("end"),
            *([F.col("r.startCpG").cast("bigint").alias("cpg_start"), F.col("r.endCpG").cast("bigint").alias("cpg_end")] if has_cpg else []),
            (F.trim(F.col(f"r.{type_column}")) if type_column else F.lit(None).cast("string")).alias("cell_type"),
        )
        return found.where(F.col("cell_type") == target_type) if target_type is not None and type_column else found

    regions = union_all([parsed(h, rows) for h, rows in split_by_header(spark, lines, path)])
    if drop_sex:
        regions = regions.where(coords.is_autosome(F.col("chr")))
    if cpg is not None:
        regions = require_cpgs(attach_cpg_range(regions, cpg))
    return regions


# Columns that rank regions, the better one first.
STATISTICS = ("areaStat", "diff.Methy")


def read_statistics_regions(spark: SparkSession, path: str, drop_sex: bool = True) -> DataFrame:
    """Tab-separated regions with a header: ``chr, start, end, ctype, statistic, row_no`` and ``dmr_id`` where the file has it.

    ``statistic`` is the absolute value of ``areaStat``, of ``diff.Methy`` in files without it, else null: the order of the
    rows (``row_no``) then ranks. Chromosomes may be named in either style; those beyond the numbered ones are dropped,
    X and Y too with ``drop_sex``. Every file is read by its own header.
    """
    lines = numbered_lines(spark, path)

    def parsed(header: str, rows: DataFrame) -> DataFrame:
        _, headers = split_header(header, "\t")
        missing = {"chr", "start", "end"} - set(headers)
        if missing:
            raise ValueError(f"regions need chr, start and end; {sorted(missing)} not in {headers}")
        schema = ", ".join(f"`{h}` string" for h in headers)
        field = lambda name, kind: F.col("r")[name].try_cast(kind)
        ranked = next((s for s in STATISTICS if s in headers), None)
        row = rows.select("file", "row_no", F.from_csv("value", schema, {"sep": "\t"}).alias("r"))
        return row.select(
            F.trim(F.col("r")["chr"]).alias("chr"), field("start", "bigint").alias("start"), field("end", "bigint").alias("end"),
            (F.col("r")["ctype"] if "ctype" in headers else F.lit(None).cast("string")).alias("ctype"),
            (F.abs(field(ranked, "double")) if ranked else F.lit(None).cast("double")).alias("statistic"), "row_no",
            *([field("dmr_id", "bigint").alias("dmr_id")] if "dmr_id" in headers else []),
        )

    found = union_all([parsed(h, rows) for h, rows in split_by_header(spark, lines, path)])
    return found.where(coords.is_kept_chromosome(F.col("chr"), drop_sex))


def read_bed(spark: SparkSession, path: str, columns: list[str], header: bool = False) -> DataFrame:
    """Tab-separated BED; columns beyond the named ones are ignored."""
    schema = ", ".join(f"`{c}` {'bigint' if c in ('start', 'end') else 'string'}" for c in columns)
    return spark.read.schema(schema).csv(path, sep="\t", header=header, comment="#")


def read_reference(spark: SparkSession, path: str | list[str], chunk: int = GENOME_CHUNK) -> DataFrame:
    """FASTA as upper-case chunks (chr, chunk_id, seq) of ``chunk`` bases; the last one is shorter.

    Works line by line, so no chromosome is ever one value: header rows act as markers, the offset
    of a line is a running total of line lengths, and a line is cut where it crosses a chunk border.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value")).where(F.col("value") != "")
    head = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S+)", 1))
    bases = (
        fill_from_marker(lines, head, "chr")
        .where(~F.col("value").startswith(">") & F.col("chr").isNotNull())
        .withColumn("_len", F.length("value").cast("long"))
    )
    placed = running(bases, ["file", "chr"], "row_no", "_len", "_at")
    last = F.floor((F.col("_at") + F.col("_len") - 1) / chunk)
    pieces = placed.withColumn("chunk_id", F.explode(F.sequence(F.floor(F.col("_at") / chunk), last)))
    low = F.greatest(F.col("chunk_id") * chunk, F.col("_at"))
    high = F.least((F.col("chunk_id") + 1) * chunk, F.col("_at") + F.col("_len"))
    piece = F.substring("value", (low - F.col("_at") + 1).cast("int"), (high - low).cast("int"))
    return (
        pieces.select("chr", "chunk_id", F.struct(low.alias("at"), F.upper(piece).alias("part")).alias("p"))
        .groupBy("chr", "chunk_id")
        .agg(F.array_sort(F.collect_list("p")).alias("ps"))  # at most `chunk` one-base pieces
        .select("chr", "chunk_id", F.array_join(F.col("ps.part"), "").alias("seq"))
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts by column name; a column that a part lacks is null in its rows."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def read_labelled_reads(spark: SparkSession, path: str, with_region_type: bool = False, labelled: bool = True) -> DataFrame:
    """Reads with any accepted delimiter and header names, projected to standard columns.

    Every file is read by its own header. Without ``labelled`` the cell type may be absent, as in the
    reads of samples that are to be scored.
    """
    required = ("dna_seq", "methyl_seq", "dmr_label") + (("ctype",) if labelled else ()) + (("dmr_ctype",) if with_region_type else ())
    optional = tuple(c for c in READ_COLUMNS if c not in required)

    def parsed(header: str, rows: DataFrame) -> DataFrame:
        delimiter, headers = split_header(header)
        names = resolve_columns(headers, required, optional)
        fields = F.from_csv("value", ", ".join(f"`{h}` string" for h in headers), {"sep": delimiter})
        row = rows.select(fields.alias("r"))
        return row.select(*[F.col(f"r.`{names[c]}`").alias(c) for c in READ_COLUMNS if c in names])

    found = union_all([parsed(h, rows) for h, rows in split_by_header(spark, numbered_lines(spark, path), path)])
    return found.select(*[c for c in READ_COLUMNS if c in found.columns])


def read_sectioned(spark: SparkSession, path: str, keep_unmarked: bool = False) -> DataFrame:
    """Labelled reads from files with one-field ``*.pat.gz`` rows; rows belong to the latest such row.

    Rows with fewer than five fields are dropped, and so are rows before the first marker unless
    ``keep_unmarked``. A repeated marker continues its section.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    is_marker = ~F.contains("value", F.lit(",")) & F.col("value").endswith(SECTION_SUFFIX)
    filled = fill_from_marker(lines, F.when(is_marker, F.col("value")), "sample_id")
    is_header = F.lower("value").startswith("dna_seq,")
    parts = F.split("value", ",")
    rows = filled.where(~is_marker & ~is_header & (F.size(parts) >= 5))
    if not keep_unmarked:
        rows = rows.where(F.col("sample_id").isNotNull())
    return rows.select(
        "sample_id", "row_no", *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(READ_COLUMNS)]
    )


def read_alignments(spark: SparkSession, path: str, filename: bool = False) -> DataFrame:
    """SAM text: header lines, duplicates (flag 1024) and reads without an XM tag are skipped.

    With ``filename`` every read carries the name of its file.

    ``pos`` is turned to 0-based; ``pos_end`` is ``pos`` plus the aligned query length.
    """
    parts = F.split("value", "\t")
    tags = F.slice(F.col("p"), 12, 1 << 20)
    xm = F.get(F.filter(tags, lambda t: t.startswith("XM:Z:")), F.lit(0))
    clipped = F.aggregate(
        F.regexp_extract_all("cigar", F.lit(r"(\d+)[SH]"), F.lit(1)), F.lit(0), lambda a, n: a + n.cast("int")
    )
    hard = F.aggregate(
        F.regexp_extract_all("cigar", F.lit(r"(\d+)H"), F.lit(1)), F.lit(0), lambda a, n: a + n.cast("int")
    )
    rows = (
        spark.read.text(path)
        .where(~F.col("value").startswith("@"))
        .select(*([F.col("_metadata.file_name").alias("filename")] if filename else []), parts.alias("p"))
        .where(F.size("p") >= 11)
        .select(
            *(["filename"] if filename else []),
            F.get("p", F.lit(0)).alias("qname"),
            F.get("p", F.lit(1)).try_cast("int").alias("flag"),
            F.get("p", F.lit(2)).alias("chr"),
            (F.get("p", F.lit(3)).try_cast("bigint") - 1).alias("pos"),
            F.get("p", F.lit(5)).alias("cigar"),
            F.get("p", F.lit(9)).alias("seq"),
            F.substring(xm, 6, 1 << 30).alias("xm"),
        )
    )
    aligned = F.length("seq") - (clipped - hard)
    return rows.where(F.col("xm").isNotNull() & (F.col("flag").bitwiseAND(1024) == 0)).withColumn(
        "pos_end", F.col("pos") + aligned
    )


def read_run_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Evaluation logs (step, loss, accuracy) of many runs; the folder name is the run."""
    raw = spark.read.schema("step bigint, loss double, acc double").csv(path, sep="\t", header=True)
    return raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("run"), "*")


def read_manifest(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Sample manifests of any of their shapes, one row per sample.

    A collective document holds paths for all next to ``cell_types``, a map of samples; any other is itself the map, from a
    cell type to paths of its own. A sample is an object, or in a collective map just the path of its PAT file. Shapes may
    differ from document to document and from entry to entry: the outer levels are read as maps of JSON text, and every value is
    parsed by what it is. ``csv_file`` is the region file that goes for the sample, ``collective`` tells the shape, and
    a document of its own type gives its key as ``cell_type`` unless the sample names one.

    ``multiline`` reads one document per file, otherwise one per line. Text that is no JSON object gives no rows.
    """
    raw = spark.read.text(path, wholetext=multiline).select(F.from_json("value", "map<string,string>").alias("doc"))
    collective = F.map_contains_key("doc", "cell_types")
    held = raw.select(
        "doc", collective.alias("collective"),
        F.explode(F.when(collective, F.from_json(F.col("doc")["cell_types"], "map<string,string>")).otherwise(F.col("doc"))).alias("sample_key", "value"),
    )
    is_object = F.ltrim("value").startswith("{")
    parsed = held.where(is_object | F.col("collective")).withColumn("e", F.from_json(F.when(is_object, F.col("value")), MANIFEST_ENTRY))
    shared = lambda name: F.when(F.col("collective"), F.col("doc")[name])
    named = F.when(~F.col("collective"), F.col("sample_key"))
    return parsed.select(
        "sample_key", F.coalesce("e.pat_file", F.when(~is_object, F.col("value"))).alias("pat_file"), "e.output_file",
        F.coalesce("e.cell_type", named).alias("cell_type"), shared("collective_csv_file").alias("collective_csv_file"),
        F.coalesce("e.csv_file", shared("collective_csv_file")).alias("csv_file"), F.coalesce("e.fasta_file", shared("fasta_file")).alias("fasta_file"),
        F.coalesce("e.cpg_bed_file", shared("cpg_bed_file")).alias("cpg_bed_file"), "collective",
    )


def read_family_schemes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Grouping schemes from text: a title line, then ``- family: type, type, ...`` lines.

    One row per (scheme, family, ctype); the result goes into ``naming.assign_family``.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value")).where(F.col("value") != "")
    is_member = F.col("value").startswith("- ")
    filled = fill_from_marker(lines, F.when(~is_member, F.col("value")), "scheme").where(is_member)
    # the last colon separates the family, whose own name may hold one
    family = F.regexp_extract("value", r"^- (.*):[^:]*$", 1)
    members = F.split(F.regexp_extract("value", r":([^:]*)$", 1), ",")
    return filled.select("scheme", F.trim(family).alias("family"), F.explode(F.transform(members, lambda m: F.trim(m))).alias("ctype")).where(
        F.col("ctype") != ""
    )


def manifest_from_names(names: DataFrame, column: str = "name", label: str = "CTC") -> DataFrame:
    """Manifest rows for the ``*.pat.gz`` names found in whitespace-separated text."""
    found = names.select(F.explode(F.split(F.col(column), r"\s+")).alias("pat_file")).where(
        F.col("pat_file").endswith(SECTION_SUFFIX)
    )
    stem = F.regexp_replace(F.regexp_replace("pat_file", r"\.pat\.gz", ""), r"\.(csi|bai|tbi|idx)$", "")
    return found.select(
        F.translate(stem, "-.", "__").alias("sample_key"),
        "pat_file",
        F.concat(stem, F.lit(".csv")).alias("output_file"),
        F.lit(label).alias("cell_type"),
    )
