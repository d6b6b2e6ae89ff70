"""Registered queries over the documents, pages, benchmark, labels and conversations tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    byte_bpe, chat_rotation, decontamination, divergence, html_content, licenses, merkle, near_dedup, sentence_piece,
    source_audit, substring_dedup, toxicity, warc_zip,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"), licenses.known_licenses(spark), licenses.WORDS)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_table(spark, sf_dir, "documents"))


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.learnt(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, machine).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_content.extracted(pages).select("page_id", "url", "text", "n_chars")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = byte_bpe.encoded(_table(spark, sf_dir, "documents"), path, pattern)
    return byte_bpe.decoded(tokens, path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotated(_table(spark, sf_dir, "conversations"))


def op10_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judged(_table(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language; nulls are empty, an empty table gives no rows."""
    return source_audit.audited(_table(spark, sf_dir, "documents"))


def op12_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document; null and empty texts have the end id alone."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    tokens = sentence_piece.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return sentence_piece.decoded(tokens.drop("text"), path).select(
        "doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.expr("agrees AND decodes").alias("agrees"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document; the proofs are held against tampered copies of a seventh of the documents.

    Null ids are not tampered with, null sizes stay null (and so verify); repeated rows are leaves of their own.
    """
    docs = _table(spark, sf_dir, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = merkle.digest_of([F.col(n) for n in names])
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = merkle.digest_of([more if n == "n_chars" else F.col(n) for n in names])
    hit = F.expr("coalesce(crc32(CAST(doc_id AS string)) % 7 = 0, false)")
    found = merkle.manifest(docs, leaf, "doc_id", "lang", {"tampered": F.when(hit, tampered)})
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof").alias("proof_sha256"),
        merkle.folded("coalesce(tampered, leaf)", "proof").alias("folded_root"),
    ).withColumn("verified", F.expr("folded_root = root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    every = (
        op1_near_dedup, op2_licenses, op3_substring_dedup, op4_warc_zip, op5_toxicity, op6_html_content, op7_byte_bpe,
        op8_decontamination, op9_chat_rotation, op10_divergence, op11_source_audit, op12_sentence_piece,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """DuckDB counterparts, where SQL can express the query."""
    return {
        "op2_licenses": licenses.oracle_sql(),
        "op9_chat_rotation": chat_rotation.oracle_sql(),
        "op11_source_audit": source_audit.oracle_sql(),
        "op13_merkle_manifest": merkle.oracle_sql(),
    }
