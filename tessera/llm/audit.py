"""Filter interaction audit: what each filter removes in every order of five filters.

One pass measures which of the filters A to E a text fails and packs that into five bits. A
precomputed table of 32 masks by 120 orders holds the step of the first filter of the order
that fails (STEPS: none does); mapInArrow indexes it with the masks of a batch, np.bincount adds up
part, order and step for each label, and the partial arrays of all tasks are summed.

E needs the whole table: a text fails it if a row of a smaller id has the same text (by a
128-bit digest). No text is joined with its copies: rows are counted by digest, part, labels and mask,
with the smallest id and how many rows have it; of a digest there are at most as many such counts
as parts and labels, and one window over them gives the smallest id of all.

Cases: a null text is an empty one, a null part the empty string; rows of a null id neither fail E nor make
others fail it, and have no labels; rows that repeat both id and text do not fail E by each other; of repeated
label rows any with 1 counts; labels other than 1 count as 0, and a part without rows has no result;
a very long text is measured as one batch of its own memory; an empty table gives no rows. Only the named columns are read.
Hot groups: copies are counted before they are shuffled; labels are copied to SALTS places, so that rows of one id
are SALTS tasks' work, and rows without an id are dealt by their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.workers import give_back, small
from tessera.runtime import spread

FILTERS = "ABCDE"
STEPS = len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that begin no code point.
INNER = bytes(range(0x80, 0xC0))
DUPLICATE = 1 << FILTERS.index("E")
#: Texts measured at once; places that the labels of an id are copied to; parts whose counts a task holds at once.
ROWS = 500
SALTS = 8
HELD = 256
LABELS = 3  # all rows, good ones, toxic ones


def first_failures() -> np.ndarray:
    """[mask, order]: the step of the order's first filter that fails, or STEPS."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, dtype=np.int64)
    for k, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            failing = (np.arange(1 << STEPS) >> FILTERS.index(order[step])) & 1 == 1
            table[failing, k] = step
    return table


def own_failures(text: bytes) -> int:
    """The bits of A to D of a UTF-8 text."""
    words = text.split()  # exactly the ASCII white space of the contract
    n, points = len(words), len(text.translate(None, INNER))
    return (
        (n < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1
        | (100 * (len(text) - len(text.translate(None, UPPER))) > UPPER_PERCENT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches, ROWS):
        digests, masks = [], []
        for x in b.column(2):
            t = x.as_py() or b""
            digests.append(hashlib.blake2b(t, digest_size=16).digest())
            masks.append(own_failures(t))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["id", "part", "digest", "mask"])
    give_back()


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, mask, good, toxic, n) to partial arrays, a row for each order and step of a part."""
    table, shape = first_failures(), (LABELS, len(ORDERS), STEPS + 1)
    width, fails = STEPS + 1, (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1
    slot = np.arange(len(ORDERS)) * width
    at = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for part, (removed, masks) in held.items():
            k = np.repeat(np.arange(len(ORDERS)), STEPS)
            all_fails, only = masks @ fails, masks[1 << np.arange(STEPS)]
            cells = [removed[label, :, :STEPS].reshape(-1) for label in range(LABELS)]
            columns = [pa.array([part] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(np.tile(np.arange(1, STEPS + 1), len(ORDERS)), pa.int32()), pa.array(np.full(len(k), masks.sum()))]
            columns += [pa.array(x) for x in (*cells, all_fails[at].reshape(-1), only[at].reshape(-1))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "k", "step", "total", "removed", "good_lost", "toxic_lost", "fails", "unique_fails"])
        held.clear()

    for b in batches:
        parts = b.column(0).dictionary_encode()
        part, mask, good, toxic, n = parts.indices.to_numpy(), *(b.column(i).to_numpy() for i in range(1, 5))
        # A mask's 120 steps, once for each part and mask of the batch, with the counts as weights.
        cell = part * (1 << STEPS) + mask
        cells = len(parts.dictionary) << STEPS
        by_label = np.stack([np.bincount(cell, n * w, cells) for w in (np.ones(len(n)), good, toxic)]).reshape(LABELS, -1, 1 << STEPS)
        for p, name in enumerate(parts.dictionary.to_pylist()):
            seen = np.flatnonzero(by_label[0, p])
            places = (slot + table[seen]).reshape(-1)
            got = np.stack([np.bincount(places, np.repeat(by_label[label, p, seen], len(ORDERS)), len(ORDERS) * width) for label in range(LABELS)])
            removed, masks = held.setdefault(name, (np.zeros(shape, np.int64), np.zeros(1 << STEPS, np.int64)))
            removed += got.reshape(shape).astype(np.int64)
            masks += by_label[0, p].astype(np.int64)
        if len(held) > HELD:
            yield from out()
    yield from out()


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Counts (part, mask, good, toxic, n), several rows of a combination, with E's bit in the mask."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    measured = spread(rows).mapInArrow(_measure, "id long, part string, digest binary, mask int")
    hashed = F.xxhash64("digest")
    measured = measured.withColumn("salt", F.when(F.col("id").isNull(), hashed).otherwise(F.pmod(hashed, F.lit(SALTS))))
    known = labels.select(F.col(key).cast("long").alias("id"), "quality", "toxic").filter("id IS NOT NULL").groupBy("id")
    known = known.agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    known = known.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    flags = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    # By the size of their file copied labels look small enough to be sent to every task, through the driver: the merge keeps them in partitions.
    rows = measured.join(known.hint("merge"), ["id", "salt"], "left").select("digest", "part", "mask", "id", *flags)
    group = ["digest", "part", "mask", "good", "toxic"]
    # Rows of an id and text at first, then the smallest id of a group with the number of its rows.
    ids = rows.groupBy(*group, "id").agg(F.count("*").alias("n"))
    per = ids.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    per = per.withColumn("passing", F.col("nameless") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    sides = F.explode(F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + DUPLICATE).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    return per.select("part", "good", "toxic", sides.alias("s")).filter("s.n > 0").select("part", "s.mask", "good", "toxic", "s.n")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order and step with the counts of the module's docstring and of the contract."""
    schema = "part string, k int, step int, total long, removed long, good_lost long, toxic_lost long, fails long, unique_fails long"
    partial = masks(docs, labels, key, text, part).mapInArrow(_tally, schema)
    sums = partial.groupBy("part", "k", "step").agg(*[F.sum(c).alias(c) for c in ("total", "removed", "good_lost", "toxic_lost", "fails", "unique_fails")])
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("k") + 1)
    sums = sums.withColumn("filter_order", order).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    so_far = F.sum("removed").over(Window.partitionBy("part", "k").orderBy("step"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return sums.select(
        "part", "filter_order", "step", (F.col("total") - so_far).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir):
    """What five filters remove from the whole documents, in all 120 orders."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH l AS (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM t LEFT JOIN l USING (doc_id)),
g AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM x p, x q, x r, x s, x u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
k AS (
  SELECT part, n, good, toxic, fails, filter_order, list_transform(range(1, 6), lambda i: fails[ascii(filter_order[i]) - 64]) AS inorder FROM g, o),
h AS (SELECT *, list_position(inorder, true) AS first FROM k),
s AS (
  SELECT part, filter_order, step, filter_order[step] AS filter,
         sum(n) FILTER (first IS NULL OR first > step) AS kept, sum(n) FILTER (first = step) AS removed,
         sum(n) FILTER (inorder[step] AND first < step) AS redundant,
         sum(n) FILTER (inorder[step] AND len(list_filter(inorder, lambda y: y)) = 1) AS unique_fails,
         sum(good) FILTER (first = step) AS good_lost, sum(toxic) FILTER (first = step) AS toxic_lost
  FROM h, (SELECT unnest(range(1, 6))::INT AS step) GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM s
"""
