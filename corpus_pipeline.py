"""A corpus pipeline: each stage works on all documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_dedup, language_id, ngram_join, pack
from tidemark.session import materialize

#: Languages of the corpus that is made.
LANGUAGES = ("en",)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in the languages of the corpus; drops those in others, texts without a letter and random letters."""
    return language_id.keep_identified(docs, wanted=LANGUAGES)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shingle links hold together."""
    return ngram_join.drop_similar(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the contaminated documents."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes what is left and packs it into sequences."""
    return pack.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", benchmark_passages),
    ("best_fit_packing", packing),
]

#: Language ID and the tokenizer are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
