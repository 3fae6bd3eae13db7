"""Removal of long repeats by a logarithmic family of sparse suffix arrays.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document of a
smaller id. Documents arrive in batches of rising ids. A batch's suffixes are sampled at
content-defined positions (the least gram hash of every ``LENGTH``-byte window), so a long
match has sampled suffixes at the same place in both documents; sorted by gram and context
they are the batch's sparse suffix array. It is merge-scanned against the existing levels of
the index and itself; then it becomes a level, and levels of equal size merge, so n batches
leave at most log2(n) + 1 levels and a suffix is rewritten as many times. The scan, which has the rows of
all levels in order anyway, writes the merged level itself.

The merge-scan sees, per gram, the suffixes' blocks: a block is the maximal stretch of windows that
share one sampled suffix, so it is known by one hash. A block that a smaller id holds is removed
whole. Other blocks can share single windows only where their left or right context agrees;
these few are opened: their windows are hashed one by one and each is decided by the smallest
id that holds it. Hashes that decide are 104 bits (block with its gram) and 128 bits (window).

Everything streams: the scan holds the distinct blocks of one gram (beyond ``HELD`` all of them
are opened, which decides the same), a text is worked in segments of 1 MB whatever its
length, and a passage that many documents share is one row per document, never a pair. Where a segment
holds a block or window twice, all but the smallest id's are decided there: these rows are dealt by document, and
of a passage that a third of all documents share one row per segment goes to the task of its gram.

The order within a level is that of the grams' hashes and contexts, not of the bytes: rows of 24 bytes. The bytes
themselves (50 per sampled suffix) would be more than three times that, beyond the disk that the work may take.

Cases: null text has no bytes; texts under ``LENGTH`` bytes are kept whole; a null id counts as
larger than all others, and null ids as equal; rows of equal ids do not remove from each other; repeated rows get equal
results; a very long text goes segment by segment; an empty table gives an empty result; other columns do not take part. What is
removed from an id is one row of hashes, so many rows of one id (not null) are one task's work.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import remove, scratch
from tessera.sources.store import exists

LENGTH, GRAM = 50, 20
LEFT, RIGHT = 15, 35  # a match that is cut on the right before RIGHT bytes reaches LEFT bytes to the left
#: Batches of the query: the second makes two levels of one batch merge, the last is scanned against levels of one and two.
BATCHES = 4
HELD = 200_000
#: Null ids stand from here on, told apart by their texts; in comparisons all are this one.
NULLS = (1 << 63) - (1 << 41)
SEGMENT, BEFORE, AFTER = 1 << 20, 16, 80
_MASK = np.uint64(SEGMENT - 1)
#: Windows whose grams are hashed at once: these arrays stay in a core's cache.
PART = 1 << 14


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, made once per worker."""

    kept: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.kept is None:
            both = []
            for x in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(SEGMENT, x, dtype=np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
            cls.kept = both[0], both[1]
        return cls.kept


class Segment:
    """Hashes and sampled suffixes of up to 1 MB of text: pieces [start, stop) of documents, in
    which the windows that start in [low, high) are this segment's to decide."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.power, self.inverse = Powers.get()
        n = len(buf)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[buf] * self.power[:n], out=self.sums[1:])
        none = np.empty(0, np.int64)
        self.low = self.high = self.at = self.piece = none
        self.block = self.key = none
        self.gram = np.empty(0, np.uint64)
        if n < LENGTH:
            return
        least = self._least(n - LENGTH + 1)
        high = np.minimum(high, stop - LENGTH + 1)
        on = high > low
        edge = np.zeros(n + 1, dtype=np.int32)
        np.add.at(edge, low[on], 1)
        np.add.at(edge, high[on], -1)
        inside = np.cumsum(edge[: n - LENGTH + 1]) > 0
        if not inside.any():
            return
        new = np.r_[True, (least[1:] != least[:-1]) | ~inside[:-1]]
        self.low = np.flatnonzero(inside & new)
        self.high = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True])
        self.at = (least[self.low] & _MASK).astype(np.int64)
        self.piece = np.searchsorted(start, self.at, side="right") - 1
        self.gram = _mix(_mix(self.plain(self.at, GRAM)) * np.uint64(0xA0761D6478BD642F) + np.uint64(1))
        size = (self.high - self.low).astype(np.uint64)
        told = self.plain(self.low, LENGTH + self.high - self.low)
        block = _mix(told + size * np.uint64(0xE7037ED1A0B428DB) + (self.at - self.low).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
        self.block = block.view(np.int64)
        # A context that the text's end cuts off matches none: it takes the block's hash.
        left, right = _mix(block + np.uint64(1)), _mix(block + np.uint64(2))
        ok = np.flatnonzero(self.at - LEFT >= start[self.piece])
        left[ok] = _mix(self.plain(self.at[ok] - LEFT, LEFT))
        ok = np.flatnonzero(self.at + RIGHT <= stop[self.piece])
        right[ok] = _mix(self.plain(self.at[ok], RIGHT))
        low24 = ((left & np.uint64(0xFFF)) << np.uint64(12)) | (right & np.uint64(0xFFF))
        self.key = ((self.gram & ~np.uint64(0xFFFFFF)) | low24).view(np.int64)

    def _least(self, n: int) -> np.ndarray:
        """Of each of the first ``n`` windows the least gram hash, its place in the low bits."""
        out = np.empty(n, dtype=np.uint64)
        width = LENGTH - GRAM + 1
        for low in range(0, n, PART):
            high = min(low + PART, n)
            top = high + width - 1
            least = _mix((self.sums[low + GRAM : top + GRAM] - self.sums[low:top]) * self.inverse[low:top])
            least &= ~_MASK
            least |= np.arange(low, top, dtype=np.uint64)
            span = 1
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            np.minimum(least[: high - low], least[width - span : width - span + high - low], out=out[low:high])
        return out

    def plain(self, at: np.ndarray, size) -> np.ndarray:
        """The polynomial hash of the bytes [at, at + size)."""
        return (self.sums[at + size] - self.sums[at]) * self.inverse[at]

    def windows(self, chosen: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, suffix number, first hash, second hash) of the windows that start from ``low`` to ``high`` at the chosen suffixes."""
        on = high >= low
        chosen, low, many = chosen[on], low[on], (high - low + 1)[on]
        who = np.repeat(chosen, many)
        begin = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        first = _mix(self.plain(begin, LENGTH))
        second = _mix(self.gram[who] + (self.at[who] - begin).astype(np.uint64))
        return begin, who, first.view(np.int64), second.view(np.int64)


def segments(texts: pa.Array) -> Iterator[tuple[Segment, np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, row of each piece, piece starts, first byte of each piece in its text)."""
    cells = texts.cast(pa.binary()).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    data = np.frombuffer(cells.buffers()[2], np.uint8) if cells.buffers()[2] else np.empty(0, np.uint8)
    k, room = 0, SEGMENT - 1
    while k < len(cells):
        j = max(k, int(np.searchsorted(offsets, offsets[k] + room, side="right")) - 1)
        if j > k:
            edges = offsets[k : j + 1] - offsets[k]
            yield Segment(data[offsets[k] : offsets[j]], edges[:-1], edges[1:], edges[:-1], edges[1:]), np.arange(k, j), edges[:-1], np.zeros(j - k, np.int64)
            k = j
            continue
        n, step = int(offsets[k + 1] - offsets[k]), room - BEFORE - AFTER
        for at in range(0, n, step):
            begin, end = max(0, at - BEFORE), min(n, at + step + AFTER)
            one = lambda x: np.array([x], dtype=np.int64)
            piece = data[offsets[k] + begin : offsets[k] + end]
            yield Segment(piece, one(0), one(end - begin), one(at - begin), one(at + step - begin)), one(k), one(0), one(begin)
        k += 1


#: States of a suffix on its way to the scan: of the batch, of the batch and decided, of a level that stays, of one that merges.
FRESH, DONE, OLD, MERGED = 0, 1, 2, 3


def suffixes(docs: DataFrame) -> DataFrame:
    """(key, block, doc, state): the sampled suffixes of (doc, text), FRESH, or DONE where the segment has them of a smaller id too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for seg, rows, _, _ in segments(b.column(1)):
                doc = ids[rows[seg.piece]]
                order = np.lexsort((doc, seg.block, seg.key))
                key, block, doc = seg.key[order], seg.block[order], doc[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])][: len(key)]
                key, block, doc = key[new], block[new], doc[new]
                first = np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])][: len(key)]
                done = _clipped(doc) > _low(first, _clipped(doc))
                state = pa.array(np.where(done, DONE, FRESH).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(block), pa.array(doc), state], names=["key", "block", "doc", "state"])

    return docs.select("doc", "text").mapInArrow(run, "key long, block long, doc long, state int")


def _clipped(doc: np.ndarray) -> np.ndarray:
    """Ids as they compare: null ids are equal."""
    return np.minimum(doc, NULLS)


def _low(first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each row the id of its run's first row."""
    return doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))] if len(doc) else doc


#: Kinds of rows that the merge-scan writes: suffixes for the level, removed blocks, opened blocks.
#: An opened block's hash has in its last two bits the sides whose contexts agree with another
#: block's (1 left, 2 right); a match can only reach beyond a context on a side that agrees.
LEVEL, REMOVED, OPENED = 0, 1, 2


def _scan(keep: bool, held_most: int):
    """Rows (key, block, doc, state) sorted by key, block and doc to rows (kind, key, block, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.int32)]
        last = (None, None, 0)  # key, block and smallest id of the last row's block
        flood = None  # a gram all of whose further blocks are opened

        def rows(kind, key, block, doc):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(block), pa.array(doc)], names=["kind", "key", "block", "doc"])

        def close(key, block, doc, state, every=False) -> Iterator[pa.RecordBatch]:
            """Emits what is known of the distinct blocks of finished grams."""
            if not len(key):
                return
            old = state >= OLD
            if keep:
                new = state != OLD
                yield rows(LEVEL, key[new], block[new], doc[new])
            side = np.full(len(key), 3 if every else 0)
            if not every:
                for bit, part in ((1, key >> 12), (2, (key >> 24 << 12) | (key & 0xFFF))):
                    order = np.argsort(part, kind="stable")
                    head = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
                    many = np.diff(np.r_[head, len(part)])
                    fresh = np.add.reduceat((~old[order]).astype(np.int64), head)
                    side[order] |= bit * np.repeat((many > 1) & (fresh > 0), many)
            on = side > 0
            if on.any():
                yield rows(OPENED, key[on], (block[on] & ~3) | side[on], doc[on])

        for b in batches:
            if not b.num_rows:
                continue
            done = b.column(3).to_numpy(zero_copy_only=False) == DONE
            if done.any():
                yield rows(REMOVED, *[b.column(i).to_numpy(zero_copy_only=False)[done] for i in range(3)])
                b = b.filter(pa.array(~done))
                if not b.num_rows:
                    continue
            key, block, doc = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            state = b.column(3).to_numpy(zero_copy_only=False)
            first = np.r_[(key[0], block[0]) != last[:2], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]
            rep = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            low = np.where(rep >= 0, doc[np.maximum(rep, 0)], last[2])
            gone = (_clipped(doc) > _clipped(low)) & (state < OLD)
            if gone.any():
                yield rows(REMOVED, key[gone], block[gone], doc[gone])
            last = (key[-1], block[-1], low[-1])
            held = [np.concatenate([h, x[first]]) for h, x in zip(held, (key, block, doc, state), strict=True)]
            gram = held[0] >> 24
            if flood is not None:
                wet = gram == flood
                yield from close(*[h[wet] for h in held], every=True)
                held = [h[~wet] for h in held]
                flood = flood if key[-1] >> 24 == flood else None
                gram = held[0] >> 24
            done = gram != key[-1] >> 24
            yield from close(*[h[done] for h in held])
            held = [h[~done] for h in held]
            if len(held[0]) > held_most:
                flood = int(key[-1] >> 24)
                yield from close(*held, every=True)
                held = [h[:0] for h in held]
        yield from close(*held)

    return run


class Index:
    """Levels of sorted suffixes in a shared folder; ``append`` takes batches of rising ids."""

    def __init__(self, spark, path: str, held_most: int = HELD):
        self.spark, self.path, self.held_most = spark, path, held_most
        self.levels: dict[int, str] = {}  # batches in the level to its folder
        self.parts: list[str] = []

    def _sorted(self, rows: DataFrame) -> DataFrame:
        gram = F.shiftright("key", 24)
        by = F.when(F.col("state") == DONE, F.xxhash64("doc", "block")).otherwise(gram)
        return rows.repartition(by).sortWithinPartitions("key", "block", "doc")

    def _level(self, path: str) -> DataFrame:
        return self.spark.read.schema("key long, block long, doc long").parquet(path)

    def append(self, docs: DataFrame, keep: bool = True) -> None:
        """Scans (doc, text) against all levels and itself; ``keep`` makes it a level."""
        run = suffixes(docs)
        size = 1
        while keep and size in self.levels:
            size *= 2
        for n, level in self.levels.items():
            run = run.unionByName(self._level(level).withColumn("state", F.lit(MERGED if n < size else OLD)))
        part = f"{self.path}/scans/scan={len(self.parts)}"
        scanned = self._sorted(run).mapInArrow(_scan(keep, self.held_most), "kind int, key long, block long, doc long")
        with tidy(self.spark, writers=3):
            scanned.write.partitionBy("kind").parquet(part)
        self.parts.append(part)
        # A batch without a suffix, where nothing merges, writes no level.
        if keep and exists(self.spark, f"{part}/kind={LEVEL}"):
            for n in [n for n in self.levels if n < size]:
                remove(self.spark, self.levels.pop(n))
            self.levels[size] = f"{part}/kind={LEVEL}"

    def found(self, kind: int) -> DataFrame:
        """(doc, block) rows of a kind over all batches."""
        whole = self.spark.read.schema("key long, block long, doc long, scan int, kind int").parquet(f"{self.path}/scans")
        return whole.filter(F.col("kind") == kind).select("doc", "block")

    def drop_levels(self) -> None:
        for level in self.levels.values():
            remove(self.spark, level)
        self.levels = {}


@contextlib.contextmanager
def tidy(spark, writers: int = 0) -> Iterator[None]:
    """Within it, the shuffle files of a finished query go at its end, and a task writes up to ``writers`` folders of a partitioned
    table at once, without a sort by folder."""
    within = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": str(writers)}
    before = {name: spark.conf.get(name, None) for name in within}
    for name, value in within.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of list cells; null as empty."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(size)], column.flatten().to_numpy(zero_copy_only=False)


def _member(of: np.ndarray, rows: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each (row, value) is in that row's list; rows rise."""
    out = np.zeros(len(of), dtype=bool)
    if not len(of):
        return out
    offsets, values = lists
    first, last = int(rows[0]), int(rows[-1]) + 1
    flat = values[offsets[first] : offsets[last]]
    if not len(flat):
        return out
    salt = np.uint64(0x9FB21C651E98DF25)
    owner = np.repeat(np.arange(first, last), np.diff(offsets[first : last + 1]))
    wanted = _mix(flat.view(np.uint64) ^ (owner.astype(np.uint64) * salt))
    mine = _mix(of.view(np.uint64) ^ (rows.astype(np.uint64) * salt))
    # A table of leading bits passes few values on to the exact comparison.
    table = np.zeros(1 << 20, dtype=bool)
    table[wanted >> np.uint64(44)] = True
    some = np.flatnonzero(table[mine >> np.uint64(44)])
    out[some] = np.isin(mine[some], wanted)
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, opened blocks) to (a, b, doc, done): the windows of opened blocks; ``done``: the segment has them of a smaller id too."""
    for b in batches:
        ids, lists = b.column(0).to_numpy(zero_copy_only=False), _lists(b.column(2))
        for seg, rows, _, _ in segments(b.column(1)):
            row = rows[seg.piece]
            one, two, both = (_member((seg.block & ~3) | side, row, lists) for side in (1, 2, 3))
            left, right = one | both, two | both
            parts = [(np.flatnonzero(left & right), 0, 0), (np.flatnonzero(left & ~right), 0, -LEFT - 1), (np.flatnonzero(right & ~left), 1 - LEFT, 0)]
            low = np.concatenate([np.maximum(seg.low[k], seg.at[k] + f) if f else seg.low[k] for k, f, _ in parts])
            high = np.concatenate([np.minimum(seg.high[k], seg.at[k] + t) if t else seg.high[k] for k, _, t in parts])
            _, who, first, second = seg.windows(np.concatenate([k for k, _, _ in parts]), low, high)
            doc = ids[row[who]]
            order = np.lexsort((doc, second, first))
            first, second, doc = first[order], second[order], doc[order]
            new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])][: len(doc)]
            done = _clipped(doc) > _low(new, _clipped(doc))
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(doc), pa.array(done)], names=["a", "b", "doc", "done"])


def _cut(with_text: bool):
    """(id, text, removed blocks, removed windows) to the digest row, or to (key, text kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, windows = _lists(b.column(2)), _lists(b.column(3))
            sizes = np.diff(windows[0])
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            edges: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            # Texts without a mark stay whole: they are not hashed.
            marked = np.flatnonzero((np.diff(blocks[0]) > 0) | (sizes > 0))
            for seg, part, start, first in segments(b.column(1).take(pa.array(marked))):
                rows = marked[part]
                row = rows[seg.piece]
                whole = _member(seg.block, row, blocks)
                lo, hi, who = seg.low[whole], seg.high[whole], seg.piece[whole]
                # Only texts with single windows to remove are hashed window by window.
                rest = np.flatnonzero(~whole & (sizes[row] > 0))
                if len(rest):
                    begin, of, a, _ = seg.windows(rest, seg.low[rest], seg.high[rest])
                    single = _member(a, row[of], windows)
                    lo, hi, who = np.r_[lo, begin[single]], np.r_[hi, begin[single]], np.r_[who, seg.piece[of[single]]]
                order = np.argsort(who, kind="stable")
                lo, hi, who = lo[order], hi[order], who[order]
                for s, e in _runs(who):
                    p = who[s]
                    shift = first[p] - start[p]
                    edges.setdefault(int(rows[p]), []).append((lo[s:e] + shift, hi[s:e] + shift + LENGTH))
            removed, spans, kept = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
            for k, t in enumerate(texts):
                if k in edges:
                    d = np.zeros(len(t) + 1, dtype=np.int32)
                    for lo, hi in edges[k]:
                        np.add.at(d, lo, 1)
                        np.add.at(d, hi, -1)
                    gone = np.cumsum(d[:-1]) > 0
                    removed[k] = gone.sum()
                    spans[k] = np.count_nonzero(gone & ~np.r_[False, gone[:-1]])
                    t = np.frombuffer(t, np.uint8)[~gone].tobytes()
                kept.append(t if with_text else hashlib.sha256(t).hexdigest())
            n = pa.array([len(t) for t in texts], pa.int64())
            last = pa.array([t.decode("utf-8", "replace") for t in kept], pa.string()) if with_text else pa.array(kept)
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(removed), pa.array(spans), last], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(x):
        head = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        yield from zip(head.tolist(), np.r_[head[1:], len(x)].tolist(), strict=True)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, with_text: bool = True, held_most: int = HELD) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) per input row; ``kept`` is the text that is left
    (bytes cut out of a character are replaced) or, without ``with_text``, its digest."""
    spark = docs.sparkSession
    unknown = F.lit(NULLS) + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 23)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(key).cast("long"), unknown).alias("doc"), F.col(text).alias("text"))
    cuts = sorted(set(rows.select("doc").approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    index = Index(spark, scratch(spark, "repeats"), held_most)
    bounds = [None, *[int(c) for c in cuts], None]
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        batch = rows if lo is None else rows.filter(F.col("doc") > lo)
        batch = batch if hi is None else batch.filter(F.col("doc") <= hi)
        # Nothing reads the level that the last batch would become.
        index.append(batch, keep=i + 2 < len(bounds))
    index.drop_levels()
    texts = rows.repartition("doc")
    opened = index.found(OPENED).groupBy("doc").agg(F.collect_set("block").alias("blocks"))
    singles = texts.join(opened, "doc").select("doc", "text", "blocks").mapInArrow(_windows, "a long, b long, doc long, done boolean")
    # What a segment has decided stands apart by document: of a common window the rest is a row per segment.
    apart = F.when(F.col("done"), F.col("doc")).otherwise(F.lit(-1))
    known = F.least("doc", F.lit(NULLS))
    low = F.min(known).over(Window.partitionBy("a", "b", apart))
    singles = singles.withColumn("low", low).filter(F.col("done") | (known > F.col("low"))).groupBy("doc").agg(F.collect_set("a").alias("windows"))
    removed = index.found(REMOVED).groupBy("doc").agg(F.collect_set("block").alias("blocks"))
    at = scratch(spark, "repeat-marks")
    with tidy(spark):
        removed.join(singles, "doc", "full_outer").write.parquet(at)
    remove(spark, index.path)
    marks = spark.read.schema("doc long, blocks array<long>, windows array<long>").parquet(at)
    out = texts.join(marks, "doc", "left").select("id", "text", "blocks", "windows")
    out = out.mapInArrow(_cut(with_text), "id long, n_bytes long, n_removed long, n_spans long, kept string")
    return out.withColumnRenamed("id", key)


def op7_repeats(spark, sf_dir):
    """Long repeats of every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).withColumnRenamed("kept", "kept_sha256")
