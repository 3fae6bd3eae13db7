"""Time-ordered target encoding with folds: rates of returned lines from strictly earlier history of other folds.

A column is encoded by one pass over rows sorted by value and time. The sort deals the rows by range,
so that a chunk is a contiguous piece of it; a common value, or a common moment, spans as many chunks as it fills.
Within a chunk the folds of a value's rows at one time are pivoted into a vector of ten counts (lines and returned
lines by fold), a prefix sum over the vectors of the value is taken, batch by batch with what the batch before has
left, and a row probes it: the total minus its own fold's component of the latest vector that is strictly earlier.
A chunk leaves one more row, its edge: the first and last value and time, and the vectors of the last value before and at
its last time. Two windows over the edges, by value, give what a value has in earlier chunks. The edges are one row per
chunk, and there are at most MOST_CHUNKS of them whatever the input is: they alone are broadcast.

Columns of a sale (all history, segment, client) are encoded over one row per sale, the others over one row per sale, item and
vendor; each pass reads the table that the one before has written in the shared folder, which then goes.

Cases: lines without a sale, or with one that has no time, are dropped; a sale that is stated more than once counts by its earliest
time, then its smallest client; null items and clients are -1, null vendors an ordinary value that stays null; a null flag
is not returned; values that the attribute tables do not know share one group with their nulls, and of repeated attribute rows the least
attribute counts; lines of one moment are no history of each other; a table without rows gives none. Only the
named columns are read, so that others, of any name, do not take part.
Hot groups: a hot value is cut by the ranges, copies of a line are counted before they are shuffled, joins with hot sales, items
and vendors have plain exchanges on both sides, which Spark can split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.repeats import tidy
from tessera.runtime import cut, remove, scratch

FOLDS = 5
UNKNOWN = -1
PRIOR = 500_000
WEIGHT = 50
MOST_CHUNKS = 10_000
RETURNED = "returned"


def rate(n: Column, s: Column, prior: Column) -> Column:
    """Smoothed share in millionths, in whole numbers; the prior where there is no history."""
    return F.when(n < 1, prior).otherwise(F.call_function("div", 1_000_000 * s + WEIGHT * prior, n + WEIGHT))


def fold_of(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


class Scan:
    """The prefix scan of one chunk, batch by batch: ``step`` gives (lines, returned lines, head) of each row.

    ``head`` is 1 for rows of the chunk's first value and time, 2 for later ones of that value, else 0.
    """

    def __init__(self):
        self.first = self.last = None  # (value, time)
        self.before = self.at = np.zeros(2 * FOLDS, np.int64)
        self.heading = True

    def step(self, value: pa.Array, time: pa.Array, fold: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = value.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        when = time.cast(pa.int64()).to_numpy(zero_copy_only=False)
        start = (value[0].as_py(), int(when[0]))
        other = np.r_[True, code[1:] != code[:-1]]
        new = other | np.r_[True, when[1:] != when[:-1]]
        group = np.cumsum(new) - 1
        size, cell = int(group[-1]) + 1, group * FOLDS + fold
        vectors = np.concatenate([np.bincount(cell, w, size * FOLDS).reshape(size, FOLDS) for w in (n, s)], axis=1).astype(np.int64)
        opens = np.maximum.accumulate(np.where(other[new], np.arange(size), 0))  # the value's first group
        before = vectors.cumsum(axis=0) - vectors
        before -= before[opens]
        same = self.last is not None and self.last[0] == start[0]
        if same:
            # The batch goes on with the value, maybe with the time too, that the one before has ended with.
            still = self.last[1] == start[1]
            before[opens == 0] += self.before + self.at
            if still:
                before[0] = self.before
        if self.first is None:
            self.first = start
        self.heading = self.heading and (self.last is None or same)
        head = np.zeros(len(group), np.int8)
        if self.heading:
            head[opens[group] == 0] = 2
            if start == self.first:
                head[group == 0] = 1
            self.heading = opens[-1] == 0
        self.at = vectors[-1] + (self.at if same and still and size == 1 else 0)
        self.before, self.last = before[-1], (value[-1].as_py(), int(when[-1]))
        found = [half.sum(axis=1)[group] - half[group, fold] for half in (before[:, :FOLDS], before[:, FOLDS:])]
        return found[0], found[1], head


_EDGE = "struct<first: {kind}, first_t: long, last: {kind}, last_t: long, before: array<long>, at: array<long>>"


def _scan(columns: list[str], key: str, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, chunk = Scan(), TaskContext.get().partitionId()
        at = {c: columns.index(c) for c in (key, "t", "fold", "n", "s")}
        for b in batches:
            if not b.num_rows:
                continue
            lines, returned, head = scan.step(b.column(at[key]), b.column(at["t"]), *(b.column(at[c]).to_numpy() for c in ("fold", "n", "s")))
            new = [pa.array(lines), pa.array(returned), pa.array(head), pa.array(np.full(b.num_rows, chunk, np.int32)), pa.nulls(b.num_rows, schema.field("edge").type)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], schema=schema)
        if scan.last is not None:
            edge = {"first": scan.first[0], "first_t": scan.first[1], "last": scan.last[0], "last_t": scan.last[1], "before": scan.before.tolist(), "at": scan.at.tolist()}
            cells = {"chunk": chunk, "edge": edge}
            yield pa.RecordBatch.from_arrays([pa.array([cells.get(f.name)], f.type) for f in schema], schema=schema)

    return run


def _offsets(edges: DataFrame) -> DataFrame:
    """(chunk, later_n, later_s, same_n, same_s): by fold, what the chunk's first value has in earlier chunks for rows of
    other folds, at a later time than the chunk's first (later) and at that time (same)."""
    slots = range(2 * FOLDS)
    zero = [F.lit(0).cast("long")] * len(slots)
    side = lambda turn, value, time, before, at: edges.select(
        "chunk", F.lit(turn).alias("turn"), F.col(f"edge.{value}").alias("value"), F.col(f"edge.{time}").alias("time"),
        *[x.alias(f"b{i}") for i, x in enumerate(before)], *[x.alias(f"a{i}") for i, x in enumerate(at)],
    )
    gives = side(1, "last", "last_t", [F.col("edge.before")[i] for i in slots], [F.col("edge.at")[i] for i in slots])
    both = side(0, "first", "first_t", zero, zero).unionByName(gives)
    earlier = lambda *by: Window.partitionBy(*by).orderBy("chunk", "turn").rowsBetween(Window.unboundedPreceding, -1)
    both = both.select(
        "chunk", "turn",
        *[F.coalesce(F.sum(F.col(f"b{i}") + F.col(f"a{i}")).over(earlier("value")), F.lit(0)).alias(f"all{i}") for i in slots],
        *[F.coalesce(F.sum(f"a{i}").over(earlier("value", "time")), F.lit(0)).alias(f"tie{i}") for i in slots],
    )

    def apart(half: int, ties: bool) -> Column:
        cells = [F.col(f"all{i}") - (F.col(f"tie{i}") if ties else 0) for i in range(half * FOLDS, (half + 1) * FOLDS)]
        return F.array(*[sum(cells[:i] + cells[i + 1 :]) for i in range(FOLDS)])

    named = {"later_n": apart(0, False), "later_s": apart(1, False), "same_n": apart(0, True), "same_s": apart(1, True)}
    return both.filter("turn = 0").select("chunk", *[x.alias(c) for c, x in named.items()])


class Passes:
    """Rows in a table that each pass over a column writes anew, with two columns more."""

    def __init__(self, rows: DataFrame, tie: list[str], chunks: int | None = None):
        self.spark, self.tie, self.paths = rows.sparkSession, tie, []
        self.chunks = min(chunks or int(self.spark.conf.get("spark.sql.shuffle.partitions")), MOST_CHUNKS)
        self.rows = self._written(rows)

    def _written(self, rows: DataFrame) -> DataFrame:
        self.paths.append(scratch(self.spark, "encoding"))
        with tidy(self.spark):
            rows.write.parquet(self.paths[-1])
        for path in self.paths[:-1]:
            remove(self.spark, path)
        self.paths = self.paths[-1:]
        return self.spark.read.schema(rows.schema).parquet(self.paths[0])

    def encode(self, key: str, n: str, s: str) -> None:
        """Adds ``n`` and ``s``: lines and returned lines of the row's history that share its ``key``."""
        rows = self.rows
        ordered = rows.repartitionByRange(self.chunks, key, "t", F.xxhash64(*self.tie)).sortWithinPartitions(key, "t")
        kind = rows.schema[key].dataType
        more = f"{n} long, {s} long, head byte, chunk int, edge {_EDGE.format(kind=kind.simpleString())}"
        schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema], *T.StructType.fromDDL(more)])
        found = self._written(ordered.mapInArrow(_scan(rows.columns, key, _arrow(schema)), schema))
        # One row per chunk, MOST_CHUNKS at most.
        offsets = _offsets(found.filter("edge IS NOT NULL").select("chunk", "edge"))
        found = found.filter("edge IS NULL").join(F.broadcast(offsets), "chunk", "left")
        own = F.col("fold") + 1
        add = lambda c, half: F.col(c) + F.when(F.col("head") == 1, F.element_at(f"same_{half}", own)).when(F.col("head") == 2, F.element_at(f"later_{half}", own)).otherwise(0)
        self.rows = found.select(*rows.columns, add(n, "n").alias(n), add(s, "s").alias(s))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _attribute(table: DataFrame, key: str, attribute: str) -> DataFrame:
    """(key, attribute), a row for each known key, written: a join with it has exchanges on both sides."""
    return cut(table.select(F.col(key).cast("long").alias(key), attribute).filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(attribute).alias(attribute))).hint("shuffle_hash")


def encode(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, chunks: int | None = None) -> DataFrame:
    """One row per sale_id, item_id and vendor_id of the lines that have a sale and a time, with its own counts and the
    counts and rates of its item, vendor and client."""
    returned = F.coalesce((F.col("flag") == RETURNED).cast("long"), F.lit(0))
    lines = lines.filter("sale_id IS NOT NULL").select(F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(F.col("item_id").cast("long"), F.lit(UNKNOWN)).alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id"), returned.alias("returned"))
    counts = [F.count("*").alias("n"), F.sum("returned").alias("s")]
    told = F.struct("sold_at", F.coalesce(F.col("client_id").cast("long"), F.lit(UNKNOWN)).alias("client_id"))
    once = sales.filter("sale_id IS NOT NULL AND sold_at IS NOT NULL").groupBy(F.col("sale_id").cast("long").alias("sale_id")).agg(F.min(told).alias("told"))
    per_sale = lines.groupBy("sale_id").agg(*counts).join(once, "sale_id").select("sale_id", F.col("told.sold_at").alias("t"), fold_of(F.col("sale_id")).alias("fold"), F.col("told.client_id").alias("client_id"), "n", "s")
    per_sale = per_sale.join(_attribute(clients, "client_id", "segment"), "client_id", "left").withColumn("everything", F.lit(0))
    a = Passes(per_sale, ["sale_id"], chunks)
    a.encode("everything", "all_n", "all_s")
    a.encode("segment", "segment_n", "segment_s")
    a.encode("client_id", "client_n", "client_s")
    c, r = F.col, lambda what, prior: rate(F.col(f"{what}_n"), F.col(f"{what}_s"), prior)
    rated = a.rows.withColumn("root", r("all", F.lit(PRIOR).cast("long")))
    rated = rated.withColumn("client_rate", r("client", r("segment", c("root")))).select("sale_id", "t", "fold", "root", "client_n", "client_rate")
    grouped = lines.groupBy("sale_id", "item_id", "vendor_id").agg(*counts).join(rated, "sale_id")
    grouped = grouped.join(_attribute(items, "item_id", "kind"), "item_id", "left").join(_attribute(vendors, "vendor_id", "nation_id"), "vendor_id", "left")
    b = Passes(grouped, ["sale_id", "item_id", "vendor_id"], chunks)
    for path in a.paths:
        remove(a.spark, path)
    b.encode("kind", "kind_n", "kind_s")
    b.encode("item_id", "item_n", "item_s")
    b.encode("nation_id", "nation_n", "nation_s")
    b.encode("vendor_id", "vendor_n", "vendor_s")
    return b.rows.select(
        "sale_id", "item_id", "vendor_id", c("n").alias("n_lines"), c("s").alias("n_returned"),
        "item_n", r("item", r("kind", c("root"))).alias("item_rate"), "vendor_n", r("vendor", r("nation", c("root"))).alias("vendor_rate"), "client_n", "client_rate",
    )


def op12_target_encoding(spark, sf_dir):
    """Rates of items, vendors and clients for every line of the shop."""
    t = lambda name, *cols: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)
    return encode(
        t("sale_lines", "sale_id", "item_id", "vendor_id", "flag"), t("sales", "sale_id", "client_id", "sold_at"),
        t("items", "item_id", "kind"), t("vendors", "vendor_id", "nation_id"), t("clients", "client_id", "segment"),
    )


def _sql_history(key: str, name: str) -> str:
    earlier = lambda x, by: f"(sum({x}) OVER (PARTITION BY {by} ORDER BY t) - sum({x}) OVER (PARTITION BY {by}, t))"
    every = f"{key}, fold" if key else "fold"
    one = key or "0"
    return ", ".join(f"{earlier(x, one)} - {earlier(x, every)} AS {name}_{x}" for x in ("n", "s"))


def _sql_rate(name: str, prior: str) -> str:
    return f"CASE WHEN {name}_n < 1 THEN {prior} ELSE (1000000 * {name}_s + 50 * ({prior})) // ({name}_n + 50) END"


# crc32 in SQL: a table of 256 remainders, then the digits of the id one by one.
OP12_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS b, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
remainders AS (SELECT list(c ORDER BY b) AS r FROM bits WHERE k = 8),
once AS (
  SELECT sale_id, min({{'t': sold_at, 'client_id': coalesce(client_id, -1)}}) AS told, sale_id::VARCHAR AS digits
  FROM sales WHERE sale_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY sale_id),
timed AS (
  SELECT sale_id, told.t AS t, told.client_id AS client_id,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(digits, ''), lambda d: ascii(d)::BIGINT)),
                     lambda c, d: xor(r[(xor(c, d) & 255) + 1], c >> 8)), 4294967295) % 5 AS fold
  FROM once, remainders),
kinds AS (SELECT item_id, min(kind) AS kind FROM items GROUP BY item_id),
nations AS (SELECT vendor_id, min(nation_id) AS nation_id FROM vendors GROUP BY vendor_id),
segments AS (SELECT client_id, min(segment) AS segment FROM clients GROUP BY client_id),
l AS (
  SELECT sale_id, coalesce(sale_lines.item_id, -1) AS item_id, vendor_id, client_id, t, fold, kind, nation_id, segment, 1 AS n, coalesce((flag = 'returned')::INT, 0) AS s
  FROM sale_lines JOIN timed USING (sale_id) LEFT JOIN kinds ON kinds.item_id = coalesce(sale_lines.item_id, -1)
       LEFT JOIN nations USING (vendor_id) LEFT JOIN segments USING (client_id)),
h AS (
  SELECT *, {_sql_history("", "all")}, {_sql_history("kind", "kind")}, {_sql_history("nation_id", "nation")}, {_sql_history("segment", "segment")},
         {_sql_history("item_id", "item")}, {_sql_history("vendor_id", "vendor")}, {_sql_history("client_id", "client")}
  FROM l),
r0 AS (SELECT *, {_sql_rate("all", "500000")} AS root FROM h),
r1 AS (SELECT *, {_sql_rate("kind", "root")} AS kind_rate, {_sql_rate("nation", "root")} AS nation_rate, {_sql_rate("segment", "root")} AS segment_rate FROM r0),
r2 AS (SELECT *, {_sql_rate("item", "kind_rate")} AS item_rate, {_sql_rate("vendor", "nation_rate")} AS vendor_rate, {_sql_rate("client", "segment_rate")} AS client_rate FROM r1)
SELECT sale_id, item_id, vendor_id, count(*)::BIGINT AS n_lines, sum(s)::BIGINT AS n_returned, min(item_n)::BIGINT AS item_n, min(item_rate)::BIGINT AS item_rate,
       min(vendor_n)::BIGINT AS vendor_n, min(vendor_rate)::BIGINT AS vendor_rate, min(client_n)::BIGINT AS client_n, min(client_rate)::BIGINT AS client_rate
FROM r2 GROUP BY sale_id, item_id, vendor_id
"""
