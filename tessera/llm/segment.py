"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text gets one space in front (the dummy prefix), spaces become the piece mark, and the
text falls into chunks (a run of spaces and the word after it; a line feed) that no piece
crosses. The pieces that fit a chunk form its lattice. Forward filtering gives each position the
total weight of its segmentations; backward sampling draws, from the end, the last piece in
proportion to the weight up to it times its own. Draws come from a counter-based hash of
(seed, row key, chunk number, step), so a row's segmentation is the same in any partitioning.

Weights: a piece has weight (1 + rank) ** -alpha, the rank being minus the model's score
(the merge order of a BPE model). Characters without a piece of their own, the mark itself
included, go to byte pieces, so decoding gives back every text exactly.

Lattices of chunks are computed once and kept up to a bound of edges per worker; all draws
of a slice of chunks are one array operation per step. A chunk of more than ``LONG`` characters (a text
without spaces) goes window by window: the forward pass keeps only the weights of the last few positions
before each window, and the backward pass builds the windows again from the last to the first, so at most
one window's edges are held, however long the run.

Cases: a null text has no pieces and decodes to null; an empty text has no pieces; very long
texts go slice by slice, and unbroken runs window by window, so beyond the text and its ids memory is bounded; rows with equal keys and texts get equal segmentations, a null key
counts as key 0; an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.workers import give_back, small

#: The default model; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 1.0, 42
MARK = "▁"
#: Stands for a literal mark while a lattice is built; a Unicode non-character that no vocabulary holds.
HIDDEN = "﷐"
CHUNK = re.compile(r"\n| *[^ \n]+| +")
#: Rows of a batch, chunks and characters drawn at once, and edges that a worker keeps.
ROWS, SLICE, SLICE_CHARS, EDGES = 100, 100_000, 500_000, 1_500_000
#: Characters of a chunk beyond which its lattice is cut in windows, and of such a window.
LONG, WINDOW = 1_000, 16_384
#: The weight of going from a character to byte pieces, where it has no piece of its own.
BYTES_WEIGHT = 1e-5


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as (text, id, log weight), the 256 byte ids, and each id's bytes."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    n: int


def vocabulary(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    """Reads a model on the driver; executors get the pieces with the function, not the file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], [-1] * 256
    for i in range(p.get_piece_size()):
        text = p.id_to_piece(i)
        if p.is_byte(i):
            byte_ids[int(text[1:-1], 16)] = i
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            if MARK in text.lstrip(MARK) or "\n" in text or HIDDEN in text:
                raise ValueError(f"piece {i} crosses a chunk")
            pieces.append((text, i, -alpha * math.log1p(max(0.0, -p.get_score(i)))))
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces")
    return Vocabulary(tuple(pieces), tuple(byte_ids), p.get_piece_size())


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit counter-based generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Trie:
    """The pieces as a trie in arrays, walked for many positions at once."""

    def __init__(self, pieces: Sequence[tuple[str, int, float]]):
        nodes: dict[tuple[int, int], int] = {}
        top, ends = 0, {}
        for text, i, w in pieces:
            at = 0
            for c in map(ord, text):
                if (got := nodes.get((at, c))) is None:
                    top += 1
                    nodes[(at, c)] = got = top
                at = got
            ends[at] = (i, w)
        self.longest = max((len(text) for text, _, _ in pieces), default=1)
        keys = np.array([(a << 21) | c for a, c in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(nodes.values()), dtype=np.int64)[order]
        self.piece, self.weight = np.full(top + 1, -1, dtype=np.int64), np.zeros(top + 1)
        for at, (i, w) in ends.items():
            self.piece[at], self.weight[at] = i, math.exp(w)

    def matches(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, piece, weight) of every piece anywhere in ``chars``."""
        at, start = np.zeros(len(chars), dtype=np.int64), np.arange(len(chars))
        out, d = [], 0
        while len(start):
            if d:
                inside = start + d < len(chars)
                start, at = start[inside], at[inside]
            key = (at << 21) | chars[start + d]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[k] == key
            start, at, d = start[on], self.to[k[on]], d + 1
            hit = self.piece[at] >= 0
            out.append((start[hit], start[hit] + d, self.piece[at[hit]], self.weight[at[hit]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Lattices:
    """Graphs of chunks in one pool of arrays. A chunk of n characters has n + 1 nodes in a row;
    node v's incoming edges begin at low[v] and have keys in (v, v + 1] by their cumulative
    share of the forward weight, and each edge has the node before it and a code: a piece, or below 0 a
    character that goes to byte pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.trie = Trie(vocabulary.pieces)
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int32)
        self.clear()

    def clear(self) -> None:
        self.ends: dict[str, int] = {}
        self.nodes = 0
        self.keys, self.before, self.code = np.empty(0), np.empty(0, np.int32), np.empty(0, np.int32)
        self.first, self.low = np.empty(0, bool), np.empty(0, np.int32)

    def add(self, chunks: Sequence[str]) -> None:
        """Adds the lattices of new chunks, all at once."""
        text = "".join([c + "\0" for c in chunks])
        points = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        own, chars = points(text), points(text.replace(MARK, HIDDEN).replace(" ", MARK))
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        last = np.cumsum(length + 1) - 1
        base = last - length
        chars[last] = 0x1FFFFF  # no character, so no piece crosses the end of a chunk
        start, stop, piece, weight = self.trie.matches(chars)
        plain = np.ones(len(chars), dtype=bool)
        plain[last] = False
        plain[start[stop == start + 1]] = False
        odd = np.flatnonzero(plain)
        start, stop = np.r_[start, odd], np.r_[stop, odd + 1]
        code, weight = np.r_[piece, -1 - own[odd]], np.r_[weight, np.full(len(odd), BYTES_WEIGHT)]
        offset = np.arange(len(chars)) - np.repeat(base, length + 1)
        order = np.lexsort((start, stop, offset[stop]))
        start, stop, code, weight = start[order], stop[order], code[order], weight[order]
        # Forward filtering, one offset of all chunks at a time; each node's sum is brought to
        # the scale of 1 and the scale kept apart as a logarithm.
        forward, scale = np.ones(len(chars)), np.zeros(len(chars))
        share = np.empty(len(start))
        bounds = np.searchsorted(offset[stop], np.arange(1, int(length.max()) + 2))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            a, z = start[lo:hi], stop[lo:hi]
            head = np.flatnonzero(np.r_[True, z[1:] != z[:-1]])
            many = np.diff(np.r_[head, hi - lo])
            top = np.maximum.reduceat(scale[a], head)
            part = forward[a] * weight[lo:hi] * np.exp(scale[a] - np.repeat(top, many))
            total = np.add.reduceat(part, head)
            share[lo:hi] = part / np.repeat(total, many)
            scale[z[head]] = top + np.log(total)
        order = np.argsort(stop, kind="stable")
        start, stop, code, share = start[order], stop[order], code[order], share[order]
        head = np.flatnonzero(np.r_[True, stop[1:] != stop[:-1]])
        run = np.cumsum(share)
        run -= np.repeat(np.r_[0.0, run[head[1:] - 1]], np.diff(np.r_[head, len(stop)]))
        run = np.minimum(run, 1.0)
        run[np.r_[head[1:], len(stop)] - 1] = 1.0
        first = np.zeros(len(chars), dtype=bool)
        first[base] = True
        many = np.bincount(stop, minlength=len(chars))
        self.low = np.concatenate([self.low, (len(self.keys) + np.cumsum(many) - many).astype(np.int32)])
        self.keys = np.concatenate([self.keys, self.nodes + stop + run])
        self.before = np.concatenate([self.before, (self.nodes + start).astype(np.int32)])
        self.code = np.concatenate([self.code, code.astype(np.int32)])
        self.first = np.concatenate([self.first, first])
        self.ends.update(zip(chunks, (self.nodes + last).tolist(), strict=True))
        self.nodes += len(chars)


def draw(lattices: Lattices, ends: np.ndarray, streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling of many chunks at once: (ids in text order, ids per chunk)."""
    keys, before, code, first = lattices.keys, lattices.before, lattices.code, lattices.first
    count = np.zeros(len(ends), dtype=np.int64)
    live, at = np.arange(len(ends)), ends
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        h = _mix(streams[live] + np.uint64((len(steps) * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF))
        u = (h >> np.uint64(11)).astype(np.float64) * 2.0**-53
        goal, edge = at + u, lattices.low[at]
        on = np.flatnonzero(keys[edge] <= goal)
        while len(on):
            edge[on] += 1
            on = on[keys[edge[on]] <= goal[on]]
        steps.append((live, code[edge]))
        count[live] += 1
        at = before[edge]
        on = ~first[at]
        live, at = live[on], at[on]
    stop = np.cumsum(count)
    out = np.empty(int(stop[-1]) if len(stop) else 0, dtype=np.int64)
    for k, (who, what) in enumerate(steps):
        out[stop[who] - 1 - k] = what
    odd = np.flatnonzero(out < 0)
    if not len(odd):
        return out.astype(np.int32), count
    # Characters without a piece become their bytes.
    points, which = np.unique(-1 - out[odd], return_inverse=True)
    raw = [chr(p).encode("utf-8", "surrogatepass") for p in points.tolist()]
    size = np.ones(len(out), dtype=np.int64)
    size[odd] = np.array([len(r) for r in raw])[which]
    place = np.cumsum(size) - size
    ids = np.empty(int(size.sum()), dtype=np.int32)
    even = out >= 0
    ids[place[even]] = out[even]
    for k, r in enumerate(raw):
        spots = place[odd[which == k]]
        for j, byte in enumerate(r):
            ids[spots + j] = lattices.byte_ids[byte]
    more = np.bincount(np.searchsorted(stop, odd, side="right"), size[odd] - 1, len(count)).astype(np.int64)
    return ids, count + more


class Run:
    """Forward filtering and backward sampling over one long chunk, window by window. Draws and the order of
    edges are those of ``Lattices`` and ``draw``; positions run through the whole chunk."""

    def __init__(self, lattices: Lattices, chunk: str):
        self.trie, self.byte_ids, self.chunk = lattices.trie, lattices.byte_ids, chunk

    def edges(self, low: int, high: int) -> tuple[list[int], list[int], list[int], list[float]]:
        """(start, stop, code, weight) of all edges that end in (low, high], by stop and start."""
        begin = max(0, low - self.trie.longest)
        text = self.chunk[begin:high]
        points = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        start, stop, piece, weight = self.trie.matches(points(text.replace(MARK, HIDDEN).replace(" ", MARK)))
        plain = np.ones(len(text), dtype=bool)
        plain[start[stop == start + 1]] = False
        odd = np.flatnonzero(plain)
        start, stop = np.r_[start, odd] + begin, np.r_[stop, odd + 1] + begin
        code, weight = np.r_[piece, -1 - points(text)[odd]], np.r_[weight, np.full(len(odd), BYTES_WEIGHT)]
        order = np.lexsort((start, stop))
        order = order[stop[order] > low]
        return tuple(x[order].tolist() for x in (start, stop, code, weight))

    def forward(self, low: int, high: int, state: list[float], shares: bool = False):
        """The weights of the last positions up to ``high`` from those up to ``low``, up to a common factor; with
        ``shares``, every edge's cumulative share and the place of each position's first edge too."""
        start, stop, code, weight = self.edges(low, high)
        f = [*state, *[0.0] * (high - low)]
        shift, n = len(state) - 1 - low, len(start)
        run, first, k = [], [], 0
        for v in range(low + 1, high + 1):
            first.append(k)
            total = 0.0
            while k < n and stop[k] == v:
                total += f[start[k] + shift] * weight[k]
                run.append(total)
                k += 1
            if shares:
                for j in range(first[-1], k):
                    run[j] /= total
            if total < 1e-200:
                # Only the ratios of the positions that an edge can still start from matter.
                most = max(f[max(0, v + shift - self.trie.longest) : v + shift] + [total])
                for j in range(max(0, v + shift - self.trie.longest), v + shift):
                    f[j] /= most
                total /= most
            f[v + shift] = total
        last = f[-(self.trie.longest + 1) :]
        return (last, start, code, run, [*first, k]) if shares else last

    def draw(self, stream: np.uint64) -> np.ndarray:
        """The ids of the chunk."""
        states, n = [[1.0]], len(self.chunk)
        lows = list(range(0, n, WINDOW))
        for low in lows[:-1]:
            states.append(self.forward(low, low + WINDOW, states[-1]))
        at, step, parts = n, 0, []
        u: list[float] = []
        for low, state in zip(lows[::-1], states[::-1], strict=True):
            if at <= low:
                continue
            _, start, code, run, first = self.forward(low, min(n, low + WINDOW), state, shares=True)
            out = []
            while at > low:
                if step % WINDOW == 0:
                    count = (np.arange(step, step + WINDOW, dtype=np.uint64)) * np.uint64(0xD1342543DE82EF95)
                    u = ((_mix(stream + count) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
                a, z, goal = first[at - low - 1], first[at - low] - 1, u[step % WINDOW]
                while a < z and run[a] <= goal:
                    a += 1
                out.append(code[a])
                at, step = start[a], step + 1
            parts.append(np.array(out[::-1], dtype=np.int64))
        codes = np.concatenate(parts[::-1])
        odd = np.flatnonzero(codes < 0)
        if not len(odd):
            return codes.astype(np.int32)
        points, which = np.unique(-1 - codes[odd], return_inverse=True)
        raw = [self.byte_ids[np.frombuffer(chr(p).encode("utf-8", "surrogatepass"), np.uint8)] for p in points.tolist()]
        cuts, pieces, before = odd.tolist(), [], 0
        for k, w in zip(cuts, which.tolist(), strict=True):
            pieces += [codes[before:k].astype(np.int32), raw[w]]
            before = k + 1
        return np.concatenate([*pieces, codes[before:].astype(np.int32)])


def encode(texts: Sequence[str | None], row_keys: np.ndarray, lattices: Lattices, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids per text) for a batch."""
    told = _mix(row_keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    parts: list[np.ndarray] = []
    per = np.zeros(len(texts), dtype=np.int64)
    chunks: list[str] = []
    owner: list[tuple[int, int, int]] = []  # text, first chunk number, chunks in the slice
    mixed = lambda who, number: _mix(told[who] + number * np.uint64(0xA0761D6478BD642F))

    def flush() -> None:
        if not chunks:
            return
        if len(lattices.keys) > EDGES:
            lattices.clear()
        if new := set(chunks).difference(lattices.ends):
            lattices.add(sorted(new))
        who = np.repeat([o[0] for o in owner], [o[2] for o in owner])
        number = np.concatenate([np.arange(f, f + n) for _, f, n in owner]).astype(np.uint64)
        ends = np.fromiter(map(lattices.ends.__getitem__, chunks), np.int64, len(chunks))
        ids, count = draw(lattices, ends, mixed(who, number))
        parts.append(ids)
        np.add.at(per, who, count)
        chunks.clear()
        owner.clear()

    def run(k: int, number: int, chunk: str) -> None:
        flush()
        parts.append(Run(lattices, chunk).draw(mixed(np.array([k]), np.array([number], dtype=np.uint64))[0]))
        per[k] += len(parts[-1])

    held = 0
    for k, text in enumerate(texts):
        if not text:
            continue
        text = " " + text
        # A long text is matched bit by bit, so that its chunks are never all held at once.
        found = iter(CHUNK.findall(text)) if len(text) <= SLICE_CHARS else (m[0] for m in CHUNK.finditer(text))
        number = 0
        while some := list(itertools.islice(found, SLICE)):
            # Almost always no chunk is long: one comparison of a slice tells.
            at = 0
            if max(map(len, some)) > LONG:
                for i, chunk in enumerate(some):
                    if len(chunk) > LONG:
                        if i > at:
                            owner.append((k, number + at, i - at))
                            chunks += some[at:i]
                        run(k, number + i, chunk)
                        held, at = 0, i + 1
            if len(some) > at:
                owner.append((k, number + at, len(some) - at))
                chunks += some[at:]
            number += len(some)
            if len(chunks) >= SLICE:
                flush()
                held = 0
        held += len(text)
        if held >= SLICE_CHARS:
            flush()
            held = 0
    flush()
    return np.concatenate(parts) if parts else np.empty(0, np.int32), per


def table(vocabulary: Vocabulary) -> list[bytes]:
    """The bytes of each id."""
    out = [b""] * vocabulary.n
    for t, i, _ in vocabulary.pieces:
        out[i] = t.replace(MARK, " ").encode("utf-8")
    for byte, i in enumerate(vocabulary.byte_ids):
        out[i] = bytes([byte])
    return out


def decode(ids: Sequence[int], bytes_of: list[bytes]) -> str:
    """The text of a sequence of ids, without the dummy prefix."""
    return b"".join(map(bytes_of.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(key, ids array<int>) per input row."""
    v = vocabulary(model, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(v)
        for b in small(batches, ROWS):
            ids, per = encode(b.column(1).to_pylist(), _keys(b.column(0)), lattices, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["key", "ids"])
        del lattices
        give_back()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", key)


def decoded(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(key, text) per input row; the inverse of ``encoded``."""
    bytes_of = table(vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [None if x is None else decode(x, bytes_of) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["key", "text"])

    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def _keys(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False)


def op4_sentencepiece(spark, sf_dir):
    """Every whole text, encoded and decoded: pieces, digest of the ids, whether the text came back."""
    v = vocabulary()
    bytes_of = table(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(v)
        for b in small(batches, ROWS):
            texts = b.column(1).to_pylist()
            ids, per = encode(texts, _keys(b.column(0)), lattices)
            cuts = np.split(ids, np.cumsum(per)[:-1])
            back = [decode(x.tolist(), bytes_of) for x in cuts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(per), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in cuts]),
                    pa.array([len(t) for t in back], pa.int64()), pa.array([(t or "") == x for t, x in zip(texts, back, strict=True)]),
                ],
                names=["doc_id", "n_pieces", "ids_sha256", "decoded_chars", "lossless"],
            )
        del lattices
        give_back()

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, decoded_chars long, lossless boolean")
