"""A pipeline from raw documents to packed training sequences.

Each stage takes the documents that the one before kept, as a written table. Toxic
documents go, then those whose language can't be told, then near-duplicates (shingles of
five words, a likeness of 0.8 or more) but for one; sources are mixed to their weights,
and what the mix takes is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelloom.llm.common import held_out, small_batches
from modelloom.llm.jaccard import Likeness, one_of_each
from modelloom.llm.language import UNDETERMINED, fit_language, predict_language
from modelloom.llm.mixing import mix_sources, mixed_rows
from modelloom.llm.packing import pack_documents
from modelloom.llm.toxicity import fit_toxicity, score_toxicity
from modelloom.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language counts as told from this probability on.
LEAST_SURE = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, weighted by the labels, does not call toxic."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return score_toxicity(docs, fit_toxicity(docs, labels)).where("predicted = 0").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told from their text; texts without a letter go."""
    docs = docs.select(*COLUMNS)
    model = fit_language(docs.where(~held_out(F.col("doc_id"))))
    told = predict_language(docs, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SURE))
    return told.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return one_of_each(docs.select(*COLUMNS), like=Likeness(words=5, percent=80))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each source: repeated rows, and one row a source cut at its budget."""
    return mixed_rows(mix_sources(docs.select(*COLUMNS)), chars_col="n_chars").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learned stages and tokenizers are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others' are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = f"{shared_folder(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
