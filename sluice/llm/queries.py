"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import collocations, conversations, licenses, token_counts, topk
from sluice.llm.base import load
from sluice.llm.embedding_dedup import near_dedup
from sluice.llm.hnsw import nearest_embeddings
from sluice.llm.mixing import mix_plan
from sluice.llm.ngram_jaccard import jaccard_components
from sluice.llm.pieces import encoding_digests
from sluice.llm.quality import score_quality
from sluice.llm.substring import substring_report
from sluice.llm.toxicity import score_toxicity


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(load(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(load(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(load(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k_embeddings(load(spark, sf_dir, "embeddings"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return encoding_digests(load(spark, sf_dir, "documents"), model or tokenizer_path("piece_bpe_32k.model"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(load(spark, sf_dir, "conversations"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_embeddings(load(spark, sf_dir, "embeddings"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_embedding_near_dedup, op3_token_counts, op4_quality_classifier,
        op5_substring_dedup, op6_source_mixing, op7_license_scan, op8_toxicity, op9_exact_top_k,
        op10_sentencepiece, op11_phrase_collocations, op12_conversation_repair, op13_nearest_neighbours)}


def oracle_sql() -> dict[str, str]:
    return {"op3_token_counts": token_counts.oracle(), "op7_license_scan": licenses.oracle(),
            "op9_exact_top_k": topk.oracle(), "op11_phrase_collocations": collocations.oracle(),
            "op12_conversation_repair": conversations.oracle()}
