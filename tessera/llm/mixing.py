"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sources share ``total`` times all words by weight; a target stops at
``cap`` times its source's size, and the excess is shared again by weight until none is
above (water filling, solved in closed form by windows over the per-source table).

Within a source the documents stand in a reproducible random order and are taken word by
word until the target is met, so a document is taken at most ``cap`` times. The source's
weight schedule w(t) = start + (stop - start) t over the training time t in [0, 1] is
integrated to its cumulative token demand; inverting that demand at the words taken
before a document gives the document's training position, by which rows are range-sorted.

Prefix sums are two-level (hash buckets, then documents within one bucket), so a source
that holds a third of all rows is never in one task, nor are the rows of one id: the order is a hash of id and
text. Only the table of sources, a row each, is worked in one task.

Cases: null text counts 0 words; null source is a source of its own, last in the order;
documents of 0 words are never taken; ties of the order are rows of one id and text, which are
interchangeable; repeated rows are taken one by one; a very long text is one document, counted whole; an empty table gives an
empty result; of ``mix`` other columns of the input are not carried, of ``whole_takes`` all are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import n_words
from tessera.runtime import cut

#: Weights and curriculum schedules (start, stop), repeating over the sources in code point order.
WEIGHTS = (3.0, 1.0, 2.0)
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
TOTAL, CAP = 1.5, 2.0
BUCKET_DIGITS = 3


def _cycle(rank: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), ((rank - 1) % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """source, source_size, rank, target from one row (source, source_size) per source.

    A source is capped when the level that fills the others exceeds its cap per weight.
    Sorted by cap per weight the capped ones are a prefix; the level is the one after it.
    """
    by_point = Window.orderBy(F.col("source").asc_nulls_last())
    r = sizes.withColumn("rank", F.row_number().over(by_point)).withColumn("w", _cycle(F.col("rank"), weights))
    r = r.withColumn("full", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("full") / F.col("w"))
    up = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    # The level if this source and all with a larger ratio were left uncapped.
    r = r.withColumn(
        "level",
        (F.lit(total) * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(up), F.lit(0.0))) / F.sum("w").over(rest),
    )
    r = r.withColumn("lambda", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    out = F.when(F.col("lambda").isNull() | (F.col("lambda") * F.col("w") >= F.col("full")), F.col("full"))
    return r.select("source", "source_size", "rank", out.otherwise(F.col("lambda") * F.col("w")).alias("target"))


def position(share: Column, rank: Column, schedules: Sequence[tuple[float, float]] = SCHEDULES) -> Column:
    """The time at which a source's cumulative demand reaches ``share`` of its target."""
    a, b = _cycle(rank, [s for s, _ in schedules]), _cycle(rank, [e for _, e in schedules])
    # a t + (b - a) t^2 / 2 = share (a + b) / 2, in the form that is stable for a = b.
    need = share * (a + b) / 2
    return 2 * need / (a + F.sqrt(a * a + 2 * (b - a) * need))


def placed(
    docs: DataFrame, key: str, text: str, source: str, weights: Sequence[float], total: float, cap: float, seed: int, carried: Sequence[str] = ()
) -> DataFrame:
    """key, source, size, source_size, target, rank, before (the source's words that stand before
    the row in its order) per input row, and the carried columns as a struct ``row``."""
    none = F.lit("")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), none), F.lit(":"), F.coalesce(F.col(text), none)).cast("binary"))
    known = F.col(source).isNotNull()
    cols = [
        F.col(key).alias("key"), F.coalesce(source, F.lit("")).alias("source"), known.alias("known"),
        n_words(F.col(text)).alias("size"), order.alias("ord"), F.substring(order, 1, BUCKET_DIGITS).alias("bucket"),
    ]
    small = docs.select(*cols)
    rows = docs.select(*cols, F.struct(*carried).alias("row")) if carried else (small := cut(small))
    per = small.groupBy("source", "known", "bucket").agg(F.sum("size").alias("bucket_size"))
    per = cut(per)
    sizes = per.groupBy("source", "known").agg(F.sum("bucket_size").alias("source_size"))
    goal = targets(sizes.select(F.when(F.col("known"), F.col("source")).alias("source"), "source_size"), weights, total, cap)
    goal = goal.withColumn("known", F.col("source").isNotNull()).fillna("", ["source"])
    in_source = Window.partitionBy("source", "known").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("prior", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0))).join(goal, ["source", "known"]).drop("bucket_size")
    in_bucket = Window.partitionBy("source", "known", "bucket").orderBy("ord", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    rows = rows.join(per, ["source", "known", "bucket"]).withColumn("before", F.col("prior") + F.col("own"))
    return rows.withColumn("source", F.when(F.col("known"), F.col("source")))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    total: float = TOTAL,
    cap: float = CAP,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    seed: int = 42,
) -> DataFrame:
    """key, source, size, source_size, target, taken, position, per input row, range-sorted by position.

    ``taken`` counts words, so a source meets its target to the word; ``position`` is where
    the first take starts (null where nothing is taken).
    """
    rows = placed(docs, key, text, source, weights, total, cap, seed)
    quota = F.floor("target")
    clamp = lambda c: F.greatest(F.lit(0), F.least(c, F.col("size")))
    takes = sum((clamp(quota - F.col("source_size") * k - F.col("before")) for k in range(1, math.ceil(cap))), clamp(quota - F.col("before")))
    rows = rows.withColumn("taken", takes.cast("long"))
    at = F.when(F.col("taken") > 0, F.round(position(F.col("before") / F.col("target"), F.col("rank"), schedules), 9))
    out = rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "taken", at.alias("position"))
    # The key splits the rows that are not taken, which all have no position.
    return out.repartitionByRange("position", key).sortWithinPartitions("position", key)


def whole_takes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    total: float = TOTAL,
    cap: float = CAP,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    seed: int = 42,
) -> DataFrame:
    """The columns of ``docs``, a row for each take, in the order of training positions.

    Documents are taken whole: a take counts if its middle word is within the target, so a
    source misses its target by less than half of one document.
    """
    rows = placed(docs, key, text, source, weights, total, cap, seed, docs.columns)
    fits = lambda k: (F.col("size") > 0) & (2 * (F.col("source_size") * k + F.col("before")) + F.col("size") <= 2 * F.col("target"))
    n = sum((fits(k).cast("int") for k in range(1, math.ceil(cap))), fits(0).cast("int"))
    rows = rows.withColumn("n", n).filter("n > 0").withColumn("take", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    share = (F.col("source_size") * F.col("take") + F.col("before")) / F.col("target")
    rows = rows.select("row", position(share, F.col("rank"), schedules).alias("position"))
    return rows.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def op8_mixing(spark, sf_dir):
    """The mix over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(rank - 1) % 3 + 1] AS w,
             [1.0::DOUBLE, 1.5::DOUBLE, 0.5::DOUBLE][(rank - 1) % 3 + 1] AS a,
             [1.0::DOUBLE, 0.5::DOUBLE, 1.5::DOUBLE][(rank - 1) % 3 + 1] AS b,
             2.0::DOUBLE * source_size AS "full" FROM r),
q AS (SELECT *, "full" / w AS ratio FROM w),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                 - coalesce(sum("full") OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
u AS (SELECT *, (SELECT level FROM v WHERE level <= ratio ORDER BY ratio, rank LIMIT 1) AS lam FROM v),
t AS (SELECT source, source_size, a, b, CASE WHEN lam IS NULL OR lam * w >= "full" THEN "full" ELSE lam * w END AS target FROM u),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM d),
k AS (SELECT c.doc_id, c.size, t.source_size, t.target, c.c, t.a, t.b,
             (greatest(0, least(floor(t.target)::BIGINT - c.c, c.size))
              + greatest(0, least(floor(t.target)::BIGINT - t.source_size - c.c, c.size)))::BIGINT AS taken
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(2 * ((c / target) * (a + b) / 2) / (a + sqrt(a * a + 2 * (b - a) * ((c / target) * (a + b) / 2))), 9) END AS position
FROM k
"""
