"""The text operators applied to whole benchmark tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelloom.llm import chat
from modelloom.llm.byte_bpe import encode_documents
from modelloom.llm.common import held_out, small_batches
from modelloom.llm.fingerprints import fingerprint_with_next
from modelloom.llm.jaccard import Likeness, similar_documents
from modelloom.llm.language import fit_language, predict_language
from modelloom.llm.licenses import scan_licenses
from modelloom.llm.mixing import mix_sources
from modelloom.llm.packing import pack_documents
from modelloom.llm.quality import BASE, judge_quality
from modelloom.llm.repair import damage_and_repair
from modelloom.llm.token_counts import count_tokens
from modelloom.llm.toxicity import fit_toxicity, score_toxicity
from modelloom.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(make):
    QUERIES[make.__name__] = make
    return make


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), keep=["doc_id"])


@query
def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_with_next(table(spark, folder, "documents"))


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = judge_quality(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select("doc_id", *BASE, "base_failed", "kept", "quality")


@query
def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = similar_documents(table(spark, folder, "documents"), like=Likeness(words=3, percent=90))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs.where(~held_out(F.col("doc_id"))))
    found = predict_language(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(table(spark, folder, "conversations"))


SQL["op8_chat_formatting"] = chat.SQL


@query
def op9_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(~held_out(F.col("doc_id")))
    found = score_toxicity(docs, fit_toxicity(docs, labels), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    outputs = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return encode_documents(table(spark, folder, "documents"), outputs=outputs, keep=["doc_id"])


@query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return damage_and_repair(spark.read.parquet(f"{folder}/conversations.parquet"))
