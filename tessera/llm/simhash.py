"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 bits, each the majority over the XXH64 (seed 42) of the text's word shingles.

Links: two fingerprints at two or fewer differing bits agree, in one of their two 32-bit
halves, up to one bit (pigeonhole). The anchors of a half are the words of a covering code
of length 32: the perfect Hamming code [31, 26] of covering radius 1 times the free last
bit. A half is within radius 1 of its home anchor; the half of a linked fingerprint is then
within radius plus threshold = 2 of that anchor. So every fingerprint is replicated to all
anchors within distance 2 of each half (2 to 17, 16.5 on average, 33 in all), and members of
an anchor are compared with those that are at home there. All links are found, none is missed.
(One code over all 64 bits would need hundreds of replicas: the Hamming code [63, 57] with
radius 1 plus threshold 2 gives 683.)

Exact copies share a fingerprint, and fingerprints are made distinct before anything is
replicated, so a group of copies of any size is one member. An anchor with more than
``BLOCK`` members is dealt into blocks that are compared block against block in tasks of
bounded size. Within one comparison only a spanning forest of the links is emitted, never
all pairs: components are the same and rows stay linear.

Cases: a null or empty text, or one without words, has fingerprint 0 and is linked like any
other; fewer words than a shingle hash as one; repeated rows each keep a row; null ids are
passed over in the smallest id and share their fingerprint's component (null if all ids of a component are null);
a very long text is shingled whole, in memory linear in its length; fingerprints at the same distance are linked alike;
an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import components
from tessera.runtime import cut

SHINGLE, SEED, THRESHOLD = 5, 42, 2
#: Members of an anchor that one task compares with each other; larger anchors are dealt into blocks.
BLOCK = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of a text's word shingles in their order, repeats included; none without words."""
    from itertools import repeat

    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)]
    return np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=max(1, len(w) - shingle + 1))


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is set that is set in over half of them."""
    cells = h.view(np.uint8).reshape(len(h), 8)
    out = 0
    for byte in range(8):
        on = np.bincount(cells[:, byte], minlength=256) @ _BITS
        for bit in np.flatnonzero(2 * on > len(h)):
            out |= 1 << (8 * byte + int(bit))
    return out


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp long) per input row."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return with_fingerprint(rows, "text", shingle).select("key", "fp")


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a column ``fp`` (replacing one of that name), in one pass."""
    rows = docs.drop("fp")
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(at)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, "fp"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())]))


def _columns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome s: the 15 patterns of weight two whose positions xor to s."""
    first = np.zeros((32, 15), dtype=np.uint64)
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        for k, (i, j) in enumerate(pairs):
            first[s, k] = (1 << (i - 1)) | (1 << (j - 1))
    single = np.array([0] + [1 << (i - 1) for i in range(1, 32)], dtype=np.uint64)
    return single, first


_SINGLE, _PAIRS = _columns()
_MASKS = np.array([sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)], dtype=np.uint64)


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code words within distance 2 of 32-bit halves: (row, anchor, whether it is the home)."""
    half = half.astype(np.uint64)
    syndrome = np.zeros(len(half), dtype=np.int64)
    for k in range(5):
        syndrome |= (np.bitwise_count(half & _MASKS[k]).astype(np.int64) & 1) << k
    home = half ^ _SINGLE[syndrome]
    row = np.arange(len(half))
    odd = np.flatnonzero(syndrome)
    second = (half[odd, None] ^ _PAIRS[syndrome[odd]]).ravel()
    return (
        np.concatenate([row, row, np.repeat(odd, 15)]),
        np.concatenate([home, home ^ np.uint64(1 << 31), second]),
        np.concatenate([np.ones(len(half), bool), np.zeros(len(half) + len(second), bool)]),
    )


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) to (anchor, fp, home); the half is the anchor's bit 32."""
    for b in batches:
        whole = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(whole), 20_000):
            fp = whole[at : at + 20_000]
            bits = fp.view(np.uint64)
            for half in (0, 1):
                row, anchor, home = anchors_of((bits >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((anchor | np.uint64(half << 32)).view(np.int64)), pa.array(fp[row]), pa.array(home)], names=["anchor", "fp", "home"]
                )


def forest(fp: np.ndarray, home: np.ndarray, threshold: int, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between members at home and all members (of the other
    block, if blocks are given and differ), by breadth-first search so that each link is looked at once."""
    fp, first = np.unique(fp, return_index=True)
    if len(fp) < 2:
        return []
    home = home[first]
    block = None if block is None else block[first]
    bits = fp.view(np.uint64)
    left = np.arange(len(fp))
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[i]) <= threshold
            if not home[i]:
                near &= home[left]
            if block is not None and block.any() and not block.all():
                near &= block[left] != block[i]
            hit = left[near]
            out += [(int(fp[i]), int(fp[j])) for j in hit]
            queue += hit.tolist()
            left = left[~near]
    return out


def _compare(threshold: int, limit: int):
    """Members sorted by anchor to edges; anchors of more than ``limit`` members come out whole, as rows of kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_anchor, held_n, spilt = None, 0, False

        def rows(kind, anchor, a, b, home):
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, anchor, np.int64)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(home, bool))],
                names=["kind", "anchor", "a", "b", "home"],
            )

        def close() -> Iterator[pa.RecordBatch]:
            if held_n >= 2 and not spilt:
                edges = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), threshold)
                if edges:
                    yield rows(0, held_anchor, [a for a, _ in edges], [b for _, b in edges], [False] * len(edges))

        for batch in batches:
            anchor, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            home = batch.column(2).to_numpy(zero_copy_only=False)
            if not len(anchor):
                continue
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            stops = np.r_[starts[1:], len(anchor)]
            # Runs of one row that neither begin nor end the batch can be passed over.
            inner = (stops - starts > 1) | (starts == 0) | (stops == len(anchor))
            for s, e in zip(starts[inner], stops[inner], strict=True):
                if held_anchor is None or anchor[s] != held_anchor:
                    yield from close()
                    held, held_anchor, held_n, spilt = [], anchor[s], 0, False
                held.append((fp[s:e], home[s:e]))
                held_n += e - s
                if held_n > limit:
                    for x, y in held:
                        yield rows(1, held_anchor, x, x, y)
                    held, spilt = [], True
        if held_anchor is not None:
            yield from close()

    return run


def links(classes: DataFrame, threshold: int = THRESHOLD, limit: int = BLOCK) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct fingerprints of ``classes`` (fp)."""
    if threshold > 2:
        raise ValueError("the covering is built for thresholds up to 2")
    members = classes.select("fp").mapInArrow(_replicate, "anchor long, fp long, home boolean")
    members = members.repartition("anchor").sortWithinPartitions("anchor")
    first = cut(members.mapInArrow(_compare(threshold, limit), "kind int, anchor long, a long, b long, home boolean"))
    edges = first.filter("kind = 0").select("a", "b")
    # Anchors beyond the limit: blocks by a hash of the member, every pair of blocks one group of at most two blocks.
    over = first.filter("kind = 1").select("anchor", F.col("a").alias("fp"), "home")
    blocks = over.groupBy("anchor").agg(F.ceil(F.count("*") * 2 / limit).cast("int").alias("k"))
    dealt = over.join(blocks, "anchor").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "home")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["own"].to_numpy()
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        found = forest(pdf["fp"].to_numpy(), pdf["home"].to_numpy(), threshold, None if i == j else own == i)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return edges.unionByName(dealt.groupBy("anchor", "i", "j").applyInPandas(pair, "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(key, fp long, component_id, root) per input row; component_id is the smallest key
    reachable, root a fingerprint that names the component."""
    fps = cut(fingerprints(docs, key, text, shingle))
    classes = fps.groupBy("fp").agg(F.min("key").alias("low"))
    roots = components(links(classes, threshold))
    # Labels per distinct fingerprint, then per row; classes without links keep their own.
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = named.join(least, "root").select("fp", "root", "component_id")
    return fps.join(labels, "fp").select(F.col("key").alias(key), "fp", "component_id", "root")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component does: the one of the
    smallest key, of rows of that key the one of the smallest fingerprint, of exact copies one."""
    told = near_duplicates(docs, key, text, shingle, threshold).filter(F.col(key).eqNullSafe(F.col("component_id")))
    best = told.groupBy("root").agg(F.min(F.struct(F.col(key).alias("k"), "fp")).alias("b")).select(F.col("b.k").alias("__k"), F.col("b.fp").alias("__fp"))
    rows = with_fingerprint(docs, text, shingle)
    kept = rows.join(best, F.col(key).cast("long").eqNullSafe(F.col("__k")) & (F.col("fp") == F.col("__fp")), "left_semi")
    return kept.dropDuplicates([key, "fp"]).drop("fp")


def op2_simhash(spark, sf_dir):
    """Every document's fingerprint and component, on 3-word shingles as the contract has it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs, shingle=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
