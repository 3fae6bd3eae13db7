"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves; a codebook per half is fitted on a bounded sample
(``SAMPLE`` distinct vectors, those with the smallest hash, ``SAMPLE_BYTES`` at most). A vector's cell is the pair of its halves'
centroids, and every vector is indexed. A query walks the pairs in order of summed distance (minus
the inner product of half and centroid) with a heap, until the cells passed hold a share of
all distinct vectors and ``top`` entries other than the query's own; the entries of these cells are
reranked by the inner product of the original vectors in double precision.

The share is calibrated on the same bounded sample: the smallest that reaches
``target`` recall there against brute force, for ``PROBES`` of its vectors. On clustered
data it is a small part; on vectors without clusters it has to be most of the index.

Routing is by cell. Neighbouring cells make a group of at most ``GROUP`` entries; a cell beyond that is
dealt over several groups of its own, row by row, so a common vector is spread too. Every entry
goes to one group and is never copied; a query goes to the groups that its walk touches, with a bitmap of
the cells visited there. A task holds one group at a time and streams any number of queries past it,
each leaving its ``top`` nearest of that group; these are merged per query.

Cases: null, zero or null- or non-finite-holding vectors, vectors of another length than the
most frequent one of the table (ties: the shorter) and rows without an id take no part, neither as
queries nor as candidates; of equal scores the smaller id comes first; repeated rows of an id
are candidates each, except to a query of that id; with fewer candidates all are
returned; an empty table gives an empty result; other columns do not take part. Texts have no
part here; a vector may be as long as a row allows, with smaller groups and a smaller sample.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import cut

#: Centroids per half: a cell holds some ``CELL`` entries, between the two bounds.
CENTROIDS, MOST_CENTROIDS, CELL = 32, 256, 64
SAMPLE, SAMPLE_BYTES, PROBES, TARGET = 20_000, 64 << 20, 200, 0.97
#: Entries of a group, their bytes, partitions at most, and queries scored at once.
GROUP, GROUP_BYTES, PARTS, AT_ONCE, TOP = 16_384, 64 << 20, 16_384, 64, 20
LOG = logging.getLogger(__name__)


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from a seeded choice; empty ones stay where they are."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = assign(x, c)
        n = np.bincount(a, minlength=len(c))
        total = np.stack([np.bincount(a, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, need: float, weight: np.ndarray | None = None, mass: float = 0.0) -> list[int]:
    """Cells in order of summed distance until they hold ``need`` entries and ``mass`` of ``weight`` (multi-sequence algorithm)."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    heap, seen, out, held, heavy = [(da[0] + db[0], 0, 0)], {(0, 0)}, [], 0, 0.0
    width = len(db)
    while heap and (held < need or heavy < mass):
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * width + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
            heavy += 0.0 if weight is None else float(weight[cell])
        if i + 1 < len(da) and (i + 1, j) not in seen:
            seen.add((i + 1, j))
            heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
        if j + 1 < width and (i, j + 1) not in seen:
            seen.add((i, j + 1))
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
    return out


class Codebooks:
    """Centroids of both halves and the calibrated share of entries to visit."""

    def __init__(self, x: np.ndarray, k: int = CENTROIDS, target: float = TARGET, top: int = TOP):
        self.half = x.shape[1] // 2
        self.a, self.b = kmeans(x[:, : self.half], k), kmeans(x[:, self.half :], k)
        cells = self.cells(x)
        counts = np.bincount(cells, minlength=len(self.a) * len(self.b))
        probes = x[:: max(1, len(x) // PROBES)][:PROBES]
        own = np.arange(len(x))[:: max(1, len(x) // PROBES)][:PROBES]
        at = []
        for q, i in zip(probes, own, strict=True):
            s = x @ q
            s[i] = -np.inf
            best = np.argsort(-s, kind="stable")[: min(top, len(x) - 1)]
            order = self.walk(q, counts, np.inf)
            passed = np.zeros(len(counts))
            passed[order] = np.cumsum(counts[order]) / len(x)
            at += passed[cells[best]].tolist()
        self.share = float(np.quantile(at, target)) if at else 1.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        return assign(x[:, : self.half], self.a) * len(self.b) + assign(x[:, self.half :], self.b)

    def walk(self, q: np.ndarray, counts: np.ndarray, need: float, weight: np.ndarray | None = None, mass: float = 0.0) -> list[int]:
        return walk(-(self.a @ q[: self.half]), -(self.b @ q[self.half :]), counts, need, weight, mass)


def grouped(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of every cell: cells in a row share a group of at most
    ``most`` entries; a larger cell has groups of its own."""
    first, many = np.zeros(len(counts), dtype=np.int64), np.maximum(1, -(-counts // most))
    group = held = 0
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if held and held + n > most:
            group, held = group + 1, 0
        first[cell] = group
        if many[cell] > 1:
            group, held = group + int(many[cell]), 0
        else:
            held += n
    return first, many


def valid(vectors: DataFrame, key: str, vector: str, width: int | None = None) -> tuple[DataFrame, int]:
    """(key, v) of the rows that take part, and the length of their vectors: ``width`` or the most frequent."""
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    # Single precision is kept while rows travel; every product is in double precision.
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(kind).alias("v"))
    rows = rows.filter(F.col("key").isNotNull() & v.isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    if width is None:
        most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        width = most["n"] if most else 0
    return rows.filter(F.size("v") == width), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List cells of one length as a matrix; vectors of one component get a second half of zero."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x if width > 1 else np.hstack([x, np.zeros_like(x)])


def sampled(rows: DataFrame, width: int) -> np.ndarray:
    """The distinct vectors with the smallest hashes, at most ``SAMPLE`` and ``SAMPLE_BYTES``."""
    most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, width))))
    h = F.xxhash64("v")
    last = rows.select(h.alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return np.empty((0, max(2, width)))
    got = rows.filter(h <= last).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(most).collect()
    x = np.array([r["v"] for r in got], dtype=np.float64)
    return x if width > 1 else np.hstack([x, np.zeros_like(x)])


class Group:
    """The entries of one group, in the order of their cells."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        cell = np.concatenate([p[0] for p in parts])
        order = np.argsort(cell, kind="stable")
        self.keys, self.x = np.concatenate([p[1] for p in parts])[order], np.concatenate([p[2] for p in parts])[order]
        self.cells, self.starts = np.unique(cell[order], return_index=True)
        self.stops = np.r_[self.starts[1:], len(cell)]

    def nearest(self, own: np.ndarray, qs: np.ndarray, marks: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, keys, scores): the nearest entries of the cells that each query visits."""
        seen = marks[:, self.cells]
        score = np.full((len(qs), len(self.x)), -np.inf)
        for k in np.flatnonzero(seen.any(axis=0)):
            who, s, e = np.flatnonzero(seen[:, k]), self.starts[k], self.stops[k]
            score[who, s:e] = qs[who] @ self.x[s:e].T
        score[own[:, None] == self.keys[None, :]] = -np.inf
        for i, line in enumerate(score):
            kth = np.partition(line, -top)[-top] if len(line) > top else -np.inf
            near = np.flatnonzero((line >= kth - 1e-9 * max(1.0, abs(kth) if np.isfinite(kth) else 1.0)) & np.isfinite(line))
            # The measure again, by a sum whose order depends on nothing but the length.
            exact = (self.x[near] * qs[i]).sum(axis=1)
            best = np.lexsort((self.keys[near], -exact))[:top]
            yield i, self.keys[near][best], exact[best]


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP, target: float = TARGET, group: int = GROUP) -> DataFrame:
    """query_id, rank, key, score: the ``top`` nearest found in ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    rows, width = valid(vectors, key, vector)
    asked, _ = valid(queries, key, vector, width)
    sample = sampled(rows, width)
    if not len(sample):
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    kind = rows.schema["v"].dataType.simpleString()
    k = int(np.clip(np.sqrt(rows.count() / CELL), CENTROIDS, MOST_CENTROIDS))
    books = Codebooks(sample, k, target, top)
    n_cells = len(books.a) * len(books.b)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = books.cells(_matrix(b.column(1), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["key", "v", "cell"])

    entries = cut(rows.mapInArrow(index, f"key long, v {kind}, cell int"))
    # At most MOST_CENTROIDS ** 2 rows.
    counts, distinct = np.zeros(n_cells, dtype=np.int64), np.zeros(n_cells)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("v")).alias("d")).collect():
        counts[r["cell"]], distinct[r["cell"]] = r["n"], min(r["n"], r["d"])
    mass = books.share * float(distinct.sum())
    first, many = grouped(counts, max(64, min(group, GROUP_BYTES // (8 * width))))
    last = int((first + many).max())
    LOG.info("%d entries, %d cells, %d groups, share to visit %.3f", counts.sum(), n_cells, last, books.share)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros(n_cells, dtype=np.int64)
        for b in batches:
            cell = b.column(2).to_numpy(zero_copy_only=False)
            # The rows of a cell go round its groups.
            order = np.argsort(cell, kind="stable")
            some, begin, size = np.unique(cell[order], return_index=True, return_counts=True)
            turn = np.empty(len(cell), dtype=np.int64)
            turn[order] = np.arange(len(cell)) - np.repeat(begin - before[some], size)
            before[some] += size
            g = first[cell] + turn % many[cell]
            none = pa.nulls(len(cell), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(g), none, b.column(0), b.column(1), b.column(2), pa.nulls(len(cell), pa.binary())], names=names)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                own = part.column(3).to_numpy(zero_copy_only=False)
                row, to, bits = [], [], []
                for i, q in enumerate(_matrix(part.column(2), width)):
                    cells = np.array(books.walk(q, counts, top + int(own[i]), distinct, mass), dtype=np.int64)
                    marks = np.zeros(n_cells, dtype=bool)
                    marks[cells] = True
                    packed = np.packbits(marks)
                    begin, size = first[cells], many[cells]
                    goals = np.unique(np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
                    row += [i] * len(goals)
                    to += goals.tolist()
                    # Of the bitmap a group gets the bytes of its own cells.
                    bits += [packed[lo:hi].tobytes() for lo, hi in zip(low[goals].tolist(), high[goals].tolist(), strict=True)]
                told = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), told.column(0), told.column(1), told.column(2), pa.nulls(len(row), pa.int32()), pa.array(bits, pa.binary())], names=names)

    names, schema = ["to", "q", "key", "v", "cell", "marks"], f"to long, q long, key long, v {kind}, cell int, marks binary"
    # The bytes of the bitmap that hold a group's cells.
    full = np.flatnonzero(counts)
    low, high = np.full(last, n_cells // 8 + 1), np.zeros(last, dtype=np.int64)
    each = np.repeat(full, many[full])
    of = np.repeat(first[full], many[full]) + np.arange(len(each)) - np.repeat(np.cumsum(many[full]) - many[full], many[full])
    np.minimum.at(low, of, each // 8)
    np.maximum.at(high, of, each // 8 + 1)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by group, its entries first; every query's nearest in the group."""
        at, parts, held = -1, [], None
        for b in batches:
            to, is_query = b.column(0).to_numpy(zero_copy_only=False), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((to[1:] != to[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(to)], strict=True):
                if s == e:
                    continue
                if to[s] != at:
                    at, parts, held = int(to[s]), [], None
                part = b.slice(s, e - s)
                if not is_query[s]:
                    parts.append((part.column(4).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False), _matrix(part.column(3), width)))
                    continue
                if held is None and not parts:
                    continue
                if held is None:
                    held, parts = Group(parts), []
                for a in range(0, part.num_rows, AT_ONCE):
                    some = part.slice(a, AT_ONCE)
                    marks = np.zeros((some.num_rows, n_cells + 8), dtype=bool)
                    bits = np.frombuffer(b"".join(some.column(5).to_pylist()), np.uint8).reshape(some.num_rows, -1)
                    marks[:, 8 * low[at] : 8 * low[at] + 8 * bits.shape[1]] = np.unpackbits(bits, axis=1)
                    q, own = (some.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                    got = [(q[[i] * len(ids)], own[[i] * len(ids)], ids, score) for i, ids, score in held.nearest(own, _matrix(some.column(3), width), marks, top)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], names=["q", "query_id", "key", "score"])

    # A query walks past the entries of its own id, however many rows have it.
    asked = asked.dropDuplicates(["key", "v"])
    copies = entries.groupBy("key").agg(F.count("*").alias("own"))
    asked = asked.join(copies, "key", "left").select("key", "v", F.coalesce("own", F.lit(0)).alias("own"))
    asked = cut(asked.select(F.monotonically_increasing_id().alias("q"), "key", "v", "own"))
    # Walks are far more work than their bytes tell: every core gets some queries.
    asked = asked.repartition(max(1, min(PARTS, -(-asked.count() // AT_ONCE))))
    both = entries.mapInArrow(place, schema).unionByName(asked.mapInArrow(plan, schema))
    both = both.repartitionById(min(last, PARTS), (F.col("to") % min(last, PARTS)).cast("int")).sortWithinPartitions("to", F.col("q").isNotNull())
    got = both.mapInArrow(answer, "q long, query_id long, key long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", F.col("key").alias(key), "score")


def op9_neighbours(spark, sf_dir):
    """The 20 nearest of every 20th vector, against all."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
