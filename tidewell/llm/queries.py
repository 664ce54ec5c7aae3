"""The thin queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, hilbert, langid, linededup, media, mixing, phrases, private, reputation, secrets, simhash, whitening
from .common import table


def _digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans, and counts of what the method added."""
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count("base", k).alias(f"n_{k}") for k in kinds], F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(secrets.scan_secrets(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def op8_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of ``embeddings``, played as tunes, are the recordings (the tables hold no audio)."""
    found = media.linked(table(spark, sf_dir, "embeddings"), id_col="vec_id", media_col="embedding", decode=media.render)
    return found.withColumnRenamed("rec_id", "vec_id")


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(private.scan_private(table(spark, sf_dir, "documents")), private.KINDS)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(spark, table(spark, sf_dir, "embeddings"))


def op12_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a page's id is its outcome: good if of quality and not toxic."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return reputation.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), F.expr("quality = 1 AND toxic = 0").alias("good")))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_source_mixing": op2_source_mixing,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_hilbert_sharding": op4_hilbert_sharding,
        "op5_line_dedup": op5_line_dedup,
        "op6_language_id": op6_language_id,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_chroma_fingerprints": op8_chroma_fingerprints,
        "op9_private_data": op9_private_data,
        "op10_context_tree_scores": op10_context_tree_scores,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_host_reputation": op12_host_reputation,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


def oracle_sql() -> dict:
    return {"op2_source_mixing": mixing.SQL, "op5_line_dedup": linededup.SQL, "op12_host_reputation": reputation.sql(), "op13_phrase_collocations": phrases.SQL}
