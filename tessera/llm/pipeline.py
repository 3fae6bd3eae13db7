"""The corpus pipeline: documents to sampled token ids.

STAGES lists (name, function); each takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next stage's docs. All but the last return
the columns of documents.

Cases, for every stage: null and empty texts pass (only the mix takes no document without a word); very long texts are
worked whole; repeated rows are rows of their own, but for the near-duplicate stage, which keeps one; null ids
and sources pass; an empty table gives an empty table; columns beyond those of documents are dropped at the first stage,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, secrets, segment, similar, toxicity
from tessera.runtime import remove, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated trees score 0.5 or more go. The model learns from the labels
    table of the corpus and the documents at hand; the score is computed in the pass that carries the row."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select(*COLUMNS), labels)
    return toxicity.scored(docs.select(*COLUMNS), model).filter("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or
    more one row stays: the one of the smallest id. The covering of SimHash fingerprints finds the close
    copies, MinHash bands those whose fingerprints are too far apart for it; the sets decide."""
    return similar.one_of_each(docs.select(*COLUMNS), "doc_id", "text").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are replaced by a mark; no document goes, and one without findings stays as it is. The ledger
    stays in the shared folder: a later scan of the same texts would find them there."""
    ledger = scratch(spark, "pipeline-ledger")
    secrets.commit(docs.select("text"), ledger)
    clean = secrets.redacted(docs.select(*COLUMNS), ledger)
    changed = F.when(F.col("__n") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each take of a document is a row, whole, where at least half of its words are within the
    source's target; documents that the mix does not take go. Rows are range-sorted by training position."""
    takes = mixing.whole_takes(docs.select(*COLUMNS), "doc_id", "text", "source")
    return takes.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled piece ids of every row."""
    ids = segment.encoded(docs.select("doc_id", "text"), "doc_id", "text")
    return ids.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


#: Trees, components and sampled segmentations are beyond SQL: tests/llm compares with a brute-force version.
ORACLE_SQL = None
