"""An encoder learned from the corpus: the leading right singular vectors of its weighted word counts.

A text is a row of weights, (1 + ln n) ln((N + 1) / (df + 1)) for each of its words that the vocabulary has, at unit length. Block iteration
finds the leading directions: every pass sends each text through the current block and back (A' A V), tasks add up what their texts
give, Spark sums the tasks' rows by word, and the driver makes the block orthogonal again. It holds VOCABULARY rows of DIMENSIONS
numbers, whatever the corpus is. Words of more than SHARE of the texts tell texts of a language apart, not texts of a matter, and are left out.
A text's vector is its row times the block, each direction in proportion to its singular value, at unit length; the block goes to each worker once.

Cases: words beyond the vocabulary take no part; a text without a word of it has no vector; with fewer words than dimensions there are as
many as words; a corpus without words cannot be fitted (ValueError).
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.vector import text_encoder
from tessera.runtime import cut, spread

DIMENSIONS, VOCABULARY, PASSES, SHARE = 48, 20_000, 4, 0.05
#: Words and texts whose numbers a task works out at once.
CHUNK, ROWS = 20_000, 500


@dataclass(frozen=True)
class Projection:
    """The place of each word, its idf, the block (word, dimension) and the singular value of each dimension."""

    place: dict[str, int]
    idf: np.ndarray
    block: np.ndarray
    values: np.ndarray

    def rows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, weight) of all texts, texts in order."""
        text, word, n = [], [], []
        for i, t in enumerate(texts):
            at = Counter(p for p in map(self.place.get, t) if p is not None)
            text += [i] * len(at)
            word += at.keys()
            n += at.values()
        text, word = np.array(text, dtype=np.int64), np.array(word, dtype=np.int64)
        weight = (1 + np.log(np.array(n, dtype=float))) * self.idf[word]
        size = np.sqrt(np.bincount(text, weight**2, len(texts)))
        return text, word, weight / np.where(size > 0, size, 1)[text]

    def forward(self, text: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        return _summed(text, word, weight, self.block, n)

    def encode(self, texts: list[list[str]]) -> list[list[float] | None]:
        x = self.forward(*self.rows(texts), len(texts)) / self.values
        size = np.sqrt((x * x).sum(axis=1))
        return [(v / s).tolist() if s > 0 else None for v, s in zip(x, size, strict=True)]


def _summed(to: np.ndarray, of: np.ndarray, weight: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each target the sum of weighted rows, some at a time."""
    k = rows.shape[1]
    out = np.zeros(n * k)
    for at in range(0, len(to), CHUNK):
        s = slice(at, at + CHUNK)
        cell = (to[s][:, None] * k + np.arange(k)).reshape(-1)
        out += np.bincount(cell, (weight[s][:, None] * rows[of[s]]).reshape(-1), n * k)
    return out.reshape(n, k)


def fit(texts: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, vocabulary: int = VOCABULARY, passes: int = PASSES, share: float = SHARE) -> Projection:
    """The projection of all ``texts``. The vocabulary is the words of most texts up to ``share``, ``vocabulary`` at most; all texts count in every pass."""
    spark = texts.sparkSession
    told = cut(spread(texts.select(F.col(text).alias("t"))).select(F.array_join(tokens(F.col("t")), " ").alias("t")))
    n = told.count()
    df = told.select(F.explode(F.array_distinct(F.split("t", " "))).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("df"))
    known = df.filter(F.col("df") <= max(1.0, share * n)).orderBy(F.desc("df"), "word").limit(vocabulary).collect()
    if not known:
        raise ValueError("there is no word to learn from")
    idf = np.log((n + 1) / (np.array([r["df"] for r in known]) + 1.0))
    k = min(dimensions, len(known))
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(len(known), k)))[0]
    out = Projection({r["word"]: i for i, r in enumerate(known)}, np.maximum(idf, 1e-6), block, np.ones(k))
    first = spark.sparkContext.broadcast(cloudpickle.dumps(out))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pickle.loads(first.value)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = [t.split(" ") for t in b.column(0).slice(at, ROWS).to_pylist()]
                i, word, weight = p.rows(some)
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(i, minlength=len(some)))].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(word.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight))], names=["word", "weight"])

    # Words become numbers once, whatever the number of passes.
    matrix = cut(told.mapInArrow(weighed, "word array<int>, weight array<double>"))
    for _ in range(passes):
        held = spark.sparkContext.broadcast(cloudpickle.dumps(out))

        def there_and_back(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            p = pickle.loads(held.value)
            total = np.zeros_like(p.block)
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    some = b.slice(at, ROWS)
                    word, weight = (some.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
                    i = np.repeat(np.arange(some.num_rows), some.column(0).value_lengths().to_numpy(zero_copy_only=False))
                    total += _summed(word, i, weight, p.forward(i, word, weight, some.num_rows), len(total))
            seen = np.flatnonzero(total.any(axis=1))
            if len(seen):
                yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *[pa.array(c) for c in total[seen].T]], names=["word", *[f"x{j}" for j in range(total.shape[1])]])

        rows = matrix.mapInArrow(there_and_back, "word int, " + ", ".join(f"x{j} double" for j in range(k)))
        # A row for each word of the vocabulary.
        sums = rows.groupBy("word").agg(*[F.sum(f"x{j}").alias(f"x{j}") for j in range(k)]).toArrow()
        moved = np.zeros((len(known), k))
        moved[sums.column("word").to_numpy()] = np.stack([c.to_numpy() for c in sums.columns[1:]], axis=1)
        held.unpersist()
        left, size, _ = np.linalg.svd(moved, full_matrices=False)
        on = size > 1e-9 * max(size.max(), 1e-300)
        out = Projection(out.place, out.idf, left[:, on], np.sqrt(size[on]))
        k = out.block.shape[1]
    return out


def encoder(projection: Projection, spark) -> Callable[[Column], Column]:
    """The projection as an encoder of texts."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(projection))

    def load():
        p = pickle.loads(held.value)
        return lambda texts: p.encode([t.split(" ") for t in texts])

    encode = text_encoder(load, ROWS)
    return lambda text: encode(F.array_join(tokens(text), " "))
