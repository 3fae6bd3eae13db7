"""Browsing, facets, documents and serialised results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import squeeze


def check_request(question: str, top_k: int = 8, q: str = "", limit: int = 30) -> None:
    """Raises ValueError outside the accepted ranges."""
    if not 1 <= len(question) <= 4000 or not 1 <= top_k <= 20 or len(q) > 300 or not 1 <= limit <= 100:
        raise ValueError("out of range")


def facet(df: DataFrame, by: str, most: int = 40) -> DataFrame:
    """Values of a column by frequency, null left out, ties by value."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(most)


def browse(docs: DataFrame, limit: int = 30, doc_type: str | None = None, year: int | None = None, key: str = "id") -> DataFrame:
    """Latest first, those without a year last."""
    if doc_type is not None:
        docs = docs.filter(F.col("doc_type") == doc_type)
    if year is not None:
        docs = docs.filter(F.col("year") == year)
    return docs.orderBy(F.desc_nulls_last("year"), key).limit(limit)


def document(docs: DataFrame, chunks: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Documents asked for (``ids``: key) with their articles in order."""
    wanted = docs.join(ids.select(key), key, "left_semi")
    own = chunks.join(ids.select(F.col(key).alias("doc_id")), "doc_id", "left_semi")
    cells = F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "chapter", "article_no", "article_title", "text")))
    return wanted.join(own.groupBy(F.col("doc_id").alias(key)).agg(cells.alias("articles")), key, "left")


def display(first: Column, second: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def serialize(hits: DataFrame) -> DataFrame:
    """Rows for a result list: citation, snippet, document id, rounded score."""
    doc = F.when(F.col("kind") == "chunk", F.substring_index("ref", "#", 1)).when(F.col("kind") == "doc", F.col("ref")).otherwise(F.lit(""))
    cite = F.when(F.coalesce("label", F.lit("")) != "", F.concat("label", F.lit(" — "), "title")).otherwise(F.col("title"))
    return hits.withColumns({"citation": cite, "snippet": F.substring("text", 1, 600), "doc_id": doc, "score": F.round("score", 4)})


def sse(event: Column) -> Column:
    """A struct as a server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row per table: name, n."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def preview(hits: DataFrame, chars: int = 200) -> DataFrame:
    """Rows for a console: place, citation, the beginning of the text on one line."""
    rows = serialize(hits)
    return rows.select("pos", "citation", F.substring(squeeze(F.col("text")), 1, chars).alias("preview"))
