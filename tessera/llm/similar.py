"""Near duplicates by Jaccard similarity: SimHash fingerprints find the close ones, MinHash bands the rest, the shingle sets decide.

Two texts are linked if the sets of their word shingles have a Jaccard similarity of ``SIMILARITY`` or more.
Every link is checked on the whole sets; candidates come by two ways, one after the other.

First by the anchor-point covering of ``simhash``: texts of one fingerprint, and those whose fingerprints differ in two
bits or fewer. Of a fingerprint every member is checked with the smallest, of linked fingerprints the smallest
members: linear rows for groups of any size. This joins most near copies into components.

A pair at 0.8 may differ in some twenty bits, beyond any covering of 64. So the members that are not joined yet are candidates where they share one of
``BANDS`` bands of ``ROWS`` minima each: a pair at 0.8 is missed with a probability of (1 - 0.8 ** 4) ** 24 = 3e-6, one at 0.9 with 2e-11.
Every member of a band is checked with the smallest member, again with linear rows, unless the covering has them in one component. Bands whose members
are still in more than one component are then compared in full, in blocks of bounded size; of these comparisons only a spanning forest of the links comes out.

Cases: texts that are the same to the byte are one member; null and empty texts and those without words have
an empty set and are linked with each other only; fewer words than a shingle are one shingle; null
ids come last in the choice of the smallest id; an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import components
from tessera.llm.workers import give_back, small
from tessera.runtime import cut

SHINGLE, SEED, BANDS, ROWS = 5, 42, 24, 4
#: The least similarity of a link, as a fraction, so that the comparison is exact.
SIMILARITY = (4, 5)
#: Members of a band, and shingles of all of them, that one task compares with each other.
BLOCK, MOST_SHINGLES = 512, 1 << 22
#: Texts, or pairs of sets, that a worker holds as sets at once.
HELD = 500


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    return np.unique(simhash.hashes(text, shingle))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
    return a | np.uint64(1), b


_A, _B = _factors()


def bands(held: np.ndarray) -> np.ndarray:
    """One hash per band of a shingle set; the band's number is part of it."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(held), 2048):
        least = np.minimum(least, (held[at : at + 2048, None] * _A + _B).min(axis=0))
    return np.array([xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)


def alike(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    """Whether sets of sizes a and b with so much in common are linked; two empty sets are."""
    return SIMILARITY[1] * common >= SIMILARITY[0] * (a + b - common)


def member(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches, HELD):
        fp, got = [], []
        for t in b.column(2):
            held = simhash.hashes(t.as_py())
            fp.append(simhash.majority(held))
            got.append(bands(np.unique(held)))
        fp = pa.array(np.array(fp, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, pa.array(got, pa.list_(pa.int64()))], names=["key", "h", "fp", "bands"])
    give_back()


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches, HELD):
        sets = [shingles(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["h", "n", "s"])
    give_back()


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb) to the pairs (a, b) that are linked."""
    for batch in small(batches, HELD):
        on = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            on.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(on, pa.bool_()))
    give_back()


def forest(h: np.ndarray, root: np.ndarray, sets: list[np.ndarray], block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all members that are linked (with the other block, if blocks are given
    and differ), where those of one root are joined already."""
    n = np.array([len(s) for s in sets])
    both = block is not None and block.any() and not block.all()
    left, out = np.arange(len(h)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            same = root[left] == root[i]
            able = ~same & (SIMILARITY[1] * np.minimum(n[left], n[i]) >= SIMILARITY[0] * np.maximum(n[left], n[i]))
            if both:
                able &= block[left] != block[i]
            near = np.zeros(len(left), dtype=bool)
            for k in np.flatnonzero(able):
                j = left[k]
                near[k] = alike(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), n[i], n[j])
            out += [(int(h[i]), int(h[j])) for j in left[near]]
            queue += left[near | same].tolist()
            left = left[~(near | same)]
    return out


def covered(members: DataFrame) -> DataFrame:
    """(a, b): candidates among ``members`` (h, fp) by the covering of fingerprints."""
    low = cut(members.groupBy("fp").agg(F.min("h").alias("hub")))
    same = members.join(low, "fp").filter("h <> hub").select(F.col("h").alias("a"), F.col("hub").alias("b"))
    of = lambda c: low.select(F.col("fp").alias(f"f{c}"), F.col("hub").alias(c))
    near = simhash.links(low.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    return same.unionByName(near.join(of("a"), "fa").join(of("b"), "fb").select("a", "b"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked by their sets; sizes that rule a link out go before sets are joined."""
    of = lambda c: sets.select(F.col("h").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}"))
    able = pairs.join(of("a").drop("sa"), "a").join(of("b").drop("sb"), "b").filter(SIMILARITY[1] * F.least("na", "nb") >= SIMILARITY[0] * F.greatest("na", "nb"))
    able = able.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb")
    return able.mapInArrow(_checked, "a long, b long")


def links(texts: DataFrame, marked: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(node, root) of the linked members of ``marked`` (h, fp, bands), whose texts are in ``texts`` (h, text)."""
    near = cut(covered(marked.select("h", "fp")))
    at = cut(marked.select(F.explode("bands").alias("band"), "h"))
    low = at.groupBy("band").agg(F.min("h").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("band", "hub")
    shared = cut(at.join(low, "band"))
    asked = shared.select("h").union(near.select("a")).union(near.select("b")).distinct()
    sets = cut(texts.join(asked, "h", "left_semi").dropDuplicates(["h"]).select("h", "text").mapInArrow(_held, "h long, n long, s binary"))
    first = components(_linked(near, sets))
    root = lambda c: first.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    pairs = shared.filter("h <> hub").select(F.col("h").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = cut(pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").filter("ra is null or rb is null or ra <> rb").select("a", "b"))
    roots = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_linked(pairs, sets)))
    # Bands with members of more than one component, one of those with the same members.
    named = shared.select("band", "h").join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h")).join(sets.select("h", "n"), "h")
    x = F.xxhash64("h")
    open_ = named.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("c"), F.bit_xor(x).alias("x"), F.sum(x.cast("decimal(38,0)")).alias("y"), F.sum("n").alias("n")).filter("r0 <> r1 and c > 2")
    open_ = open_.groupBy("c", "x", "y").agg(F.min("band").alias("band"), F.max("n").alias("n"))
    open_ = cut(open_.select("band", F.greatest(F.ceil(F.col("c") * 2 / limit), F.ceil(F.col("n") * 2 / MOST_SHINGLES)).cast("int").alias("k")))
    if open_.isEmpty():
        return roots
    dealt = named.select("band", "h", "root").join(open_, "band").withColumn("own", F.pmod(F.xxhash64("h"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "h", "root").join(sets.select("h", "s"), "h")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        own, i, j = pdf["own"].to_numpy(), pdf["i"].iat[0], pdf["j"].iat[0]
        got = forest(pdf["h"].to_numpy(), pdf["root"].to_numpy(), [np.frombuffer(s, np.uint64) for s in pdf["s"]], None if i == j else own == i)
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    more = dealt.groupBy("band", "i", "j").applyInPandas(pair, "a long, b long")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component of links does: the one of the
    smallest key, of rows of that key the one of the smallest hash, of exact copies one."""
    rows = docs.select(F.col(key).cast("long").alias("key"), member(text).alias("h"), F.col(text).alias("text"))
    told = cut(rows.mapInArrow(_marked, "key long, h long, fp long, bands array<long>"))
    classes = told.groupBy("h").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    roots = links(rows.select("h", "text"), classes, limit)
    named = told.select("key", "h").join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("no"), "key", "h")).alias("b")).select(F.col("b.key").alias("__k"), F.col("b.h").alias("__m"))
    kept = docs.withColumn("__h", member(text))
    kept = kept.join(best, F.col(key).cast("long").eqNullSafe(F.col("__k")) & (F.col("__h") == F.col("__m")), "left_semi")
    return kept.dropDuplicates([key, "__h"]).drop("__h")
