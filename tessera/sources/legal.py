"""Readers of the legal corpora and the relations that they become."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import EXPIRED, LEGAL, Profile
from tessera.functions.text import expired_flag, flatten_list
from tessera.operators.split import split_documents

#: Columns of the corpora, and the names they get.
DOC_COLUMNS = ("id", "doc_type", "doc_number", "year", "issuer", "tier", "legal_area", "title", "url", "issue_date", "effective_date", "status", "signer", "num_articles", "vn_chars", "vn_text")
QA_COLUMNS = ("id", "url", "question", "answer", "area", "category", "published_date", "summary", "keywords", "num_citations", "answer_chars")
TERM_COLUMNS = {
    "term_id": "term_id", "term_name_vi": "term_vi", "term_name_en": "term_en", "definition_vi": "definition_vi",
    "area_name_vi": "area", "status_vi": "status", "source_url": "url", "related_term_names_vi": "related",
}


def read_documents(spark: SparkSession, path: str, pattern: str = "documents*") -> DataFrame:
    """The document shards, pruned to the columns in use."""
    return spark.read.option("pathGlobFilter", pattern).parquet(path).select(*DOC_COLUMNS)


def documents(raw: DataFrame, profile: Profile = LEGAL) -> tuple[DataFrame, DataFrame]:
    """(docs, chunks): metadata with expired and has_text, and the articles of documents up to the chunking tier."""
    rows = raw.withColumn("expired", expired_flag(F.col("status"), EXPIRED))
    worth = rows.filter((F.coalesce("vn_text", F.lit("")) != "") & (F.col("tier") <= profile.chunk_max_tier))
    chunks = split_documents(worth, profile, "id", "vn_text")
    with_text = chunks.select(F.col("doc_id").alias("id")).distinct().withColumn("__has", F.lit(1))
    docs = rows.drop("vn_text").join(with_text, "id", "left").withColumn("has_text", F.coalesce("__has", F.lit(0))).drop("__has")
    return docs, chunks


def questions(spark: SparkSession, path: str, pattern: str = "documents*") -> DataFrame:
    raw = spark.read.option("pathGlobFilter", pattern).parquet(path).select(*QA_COLUMNS)
    return raw.withColumn("keywords", flatten_list(F.col("keywords")))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.parquet(path).select(*[F.col(a).alias(b) for a, b in TERM_COLUMNS.items()])
    return raw.withColumn("related", flatten_list(F.col("related")))


def corpus_statistics(docs: DataFrame, chunks: DataFrame, qa: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: rows of each relation, documents with text, documents expired."""
    d = docs.agg(F.count("*").alias("docs"), F.count_if(F.col("has_text") == 1).alias("with_text"), F.count_if(F.col("expired") == 1).alias("expired"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return d.crossJoin(n(chunks, "chunks")).crossJoin(n(qa, "qa")).crossJoin(n(terms, "terms"))
