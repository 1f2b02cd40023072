"""The queries opN_<name> and the pipeline over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwise.llm import decontamination, embeddings, html, merkle, mixing, quality, ranked_search, secrets, sharding, shingle_join, substrings, token_records, toxicity
from strandwise.llm.labelled import held_out
from strandwise.llm.sql import OP5_SQL, OP6_SQL, OP7_SQL, OP9_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from strandwise.session import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), out="toxicity", keep=["doc_id"])
    score = F.col("toxicity.score")
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )


@query("op2_main_text")
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"), out="main", keep=["page_id", "url"])
    return found.select("page_id", "url", F.col("main.text").alias("text"), F.length("main.text").cast("long").alias("n_chars"))


@query("op3_substring_removal")
def op3_substring_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_spans(table(spark, sf_dir, "documents"), out="r", keep=["doc_id"])
    return found.select("doc_id", "r.n_bytes", "r.n_removed", "r.n_spans", "r.kept_sha256")


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), out="secrets", keep=["doc_id"])
    s = F.col("secrets")
    return found.select(
        "doc_id", *[secrets.count(s, k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(secrets.joined(secrets.base_spans(s)), 256).alias("base_sha256"), secrets.joined(s["spans"]).alias("spans"),
    )


@query("op5_embedding_near_duplicates", OP5_SQL)
def op5_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query("op6_decontamination", OP6_SQL)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), out="c", keep=["doc_id"]
    )
    c = F.col("c")
    return found.select(
        "doc_id", F.col("c.n_words").alias("n_words"), decontamination.hit_words(c).alias("n_hit"),
        F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("c.items"), ","), 256).alias("items_sha256"),
        decontamination.is_contaminated(c).alias("contaminated"),
    )


@query("op7_shingle_join", OP7_SQL)
def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shingle_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("op8_token_records")
def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_records.write_records(docs, token_records.new_folder(docs))
    return token_records.read_records(manifest).select(F.col("key").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op9_source_mix", OP9_SQL)
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(stage(docs, "mix-sizes"), F.col("size"), out="mix")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def _grade():
    """Grades of the labels: 0 poor, 1 well written but toxic, 2 good."""
    return F.col("quality") * (F.lit(2) - F.coalesce("toxic", F.lit(0)))


@query("op10_quality_grade")
def op10_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), _grade(), 3)
    q = F.col("quality")
    return quality.grade(docs, model, out="quality", keep=["doc_id"]).select(
        "doc_id", held_out("doc_id").alias("held_out"), q["expected_grade"].alias("expected_grade"),
        q["tails"][0].alias("p_acceptable"), q["tails"][1].alias("p_good"), (q["tails"][0] >= 0.5).alias("keep"),
    )


@query("op11_ranked_search", OP11_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_sharding", OP12_SQL)
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    placed = sharding.shard(docs, shards=8, keep=["doc_id", "text_crc32"])
    return placed.select(
        "doc_id", "shard.size", "text_crc32", F.lit("bytes").alias("law"), "shard.shard", "shard.slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    altered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    # null where tampering changes nothing
    docs = docs.withColumn("tampered", F.when(altered, merkle.leaf(*fields, F.replace(F.col("text"), F.lit("\n"), F.lit("")))))
    found = merkle.manifest(docs, [*fields, "text"], keep=["doc_id", "tampered"])
    m = F.col("merkle")
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", m["leaf"]), m["path"]))
    return found.select(
        "doc_id", m["leaf"].alias("leaf"), m["subroot"].alias("subroot"), m["root"].alias("root"),
        merkle.proof_digest(m["path"]).alias("proof_sha256"), "folded_root", (F.col("folded_root") == m["root"]).alias("verified"),
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
