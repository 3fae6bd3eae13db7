"""Language-model scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are the words of the text, A-Z in lower case, then one end. The model predicts a symbol from the two before it:
a symbol is one of the WORDS most frequent training words, the end, or an ending, the class of all other words
whose last two bytes have the same crc32 modulo ENDINGS. A context is h = c1 * r(w-1) + c2 * r(w-2), the score of a
symbol h . q + b, its probability the softmax over all SYMBOLS. A word of an ending has the symbol's probability times its add-one
share (c + 1) / Z of the training tokens of the ending, where one unseen word has a share too: the probabilities of
all words and one unseen word of each ending add up to 1.

Corpus statistics cover all rows: words are counted by task, then by word. The most frequent words, COMMON at most (a bound on what goes to the
driver and to workers), are scored where the text is read; a text's other words leave it with their numbers and meet the whole table of
counts in a join, so that any vocabulary gives exact counts. The model starts on a sample of about WARM_ROWS training rows (a documented bound), of which
it sees TRAINED tokens, by as many passes as that takes; this breaks the symmetry. Then it goes over every training row once: tasks train apart from the same start,
and their parameters are averaged by tokens, as sums of SYMBOLS rows in Spark. Both steps are the same for a corpus of any size. The normaliser is a table over all pairs
of context symbols, made once by batched matrix products; a token's log probability is then a dot product less an entry of it.

Cases: a null text is empty, and an empty one is its end alone; null ids are text that no modulus holds out (null is not 2), so they train;
repeated rows count and are scored as often as they stand; ties of frequency among the model's words fall back on the word; without training rows every token is
unseen and the model is uniform; very long texts are read in pieces of BLOCK bytes, cut at white space (one unbroken word is one piece);
an empty table gives an empty result; other columns do not take part. Scores follow the model, which depends on how rows are dealt to
tasks (the base score does not).
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.repeats import tidy
from tessera.llm.workers import give_back, small
from tessera.runtime import scratch, spread

FOLDS, HELD_OUT = 7, 2
WORDS, ENDINGS = 960, 63
SYMBOLS = WORDS + ENDINGS + 1
END, START = SYMBOLS - 1, SYMBOLS  # the start is a context only
WIDTH = 16
CONTEXT = 2
COMMON = 150_000
WARM_ROWS = 3000
#: Tokens that the start trains on, of whatever corpus.
TRAINED = 4_000_000
BATCH, NOISE, RATE = 1024, 64, 0.15
ROWS = 300
BLOCK = 1 << 20
#: Distinct words that a counting task holds.
HELD = 300_000


def share(spark, value) -> Broadcast:
    """A broadcast that workers read with pickle.loads, whether or not they have this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    at = 0
    while len(text) - at > BLOCK:
        end = at + BLOCK
        while end < len(text) and text[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            end += 1
        yield text[at:end].lower().split()
        at = end
    yield text[at:].lower().split()


def ending(word: bytes) -> int:
    return WORDS + zlib.crc32(word[-2:]) % ENDINGS


class Bilinear:
    """Parameters, NCE training and log probabilities (natural) of symbols. One row of the parameters belongs to
    each context symbol (r), each symbol (q with its bias) and each position of the context (c)."""

    def __init__(self, unigram: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.noise = unigram / unigram.sum()
        self.r = rng.normal(0, 0.3, (SYMBOLS + 1, WIDTH)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (SYMBOLS, WIDTH)).astype(np.float32)
        self.b = np.log(self.noise).astype(np.float32)
        self.c = np.ones((CONTEXT, WIDTH), np.float32)
        self.sizes = [np.ones(len(x), np.float32) for x in (self.r, self.q, self.b, self.c)]
        self.tokens = 0
        #: Of the noise, made where it is first needed: cumulated shares and levels.
        self.cdf = self.level = None

    def hidden(self, context: np.ndarray) -> np.ndarray:
        return sum(self.c[i] * self.r[context[:, i]] for i in range(CONTEXT))

    def _move(self, which: int, gradient: np.ndarray) -> None:
        """A step of Adagrad with one size per parameter row."""
        x, size = (self.r, self.q, self.b, self.c)[which], self.sizes[which]
        wide = gradient.reshape(len(x), -1)
        size += _dots(wide, wide) / wide.shape[1]
        wide *= (RATE / np.sqrt(size))[:, None]
        x += wide.reshape(x.shape)

    def train(self, context: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        """One step on a batch, against noise symbols that the batch shares."""
        if self.cdf is None:
            self.cdf, self.level = np.cumsum(self.noise), np.log(NOISE * self.noise).astype(np.float32)
            self.cdf /= self.cdf[-1]
        noise = self.cdf.searchsorted(rng.random(NOISE), side="right")
        before, q, far = [self.r[context[:, i]] for i in range(CONTEXT)], self.q[target], self.q[noise]
        h = sum(self.c[i] * before[i] for i in range(CONTEXT))
        own = _dots(h, q) + (self.b - self.level)[target]
        down = h @ far.T
        down += (self.b - self.level)[noise]
        up = (1 / (1 + np.exp(own))).astype(np.float32)  # of the token: 1 - sigmoid
        np.negative(down, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)  # of the noise
        gh = up[:, None] * q
        gh += down @ far
        both = np.r_[target, noise]
        parts = [(context[:, i], self.c[i] * gh, _dots(gh.T, before[i].T)) for i in range(CONTEXT)]
        gr = _sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), len(self.r))
        self._move(1, _sums(both, np.concatenate([up[:, None] * h, down.T @ h]), SYMBOLS))
        self._move(2, np.bincount(both, np.r_[up, down.sum(axis=0)], SYMBOLS))
        self._move(0, gr)
        self._move(3, np.stack([p[2] for p in parts]) / math.sqrt(len(target)))
        self.tokens += len(target)

    def normaliser(self, last: np.ndarray) -> np.ndarray:
        """log of the sum of exp of all scores: for each last symbol, by the one before it."""
        before = self.c[1] * self.r
        out = np.empty((len(last), SYMBOLS + 1), np.float32)
        for k, w in enumerate(last):
            scores = (before + self.c[0] * self.r[w]) @ self.q.T + self.b
            top = scores.max(axis=1, keepdims=True)
            out[k] = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))
        return out

    def log_probability(self, context: np.ndarray, target: np.ndarray, normaliser: np.ndarray) -> np.ndarray:
        return _dots(self.hidden(context), self.q[target]) + self.b[target] - normaliser[context[:, 0], context[:, 1]]

    def rows(self) -> np.ndarray:
        """All parameters and step sizes, a row each: r, q with b, c."""
        sizes = [self.sizes[0], self.sizes[1], self.sizes[3]]
        more = [np.zeros((len(self.r), 2)), np.stack([self.b, self.sizes[2]], axis=1), np.zeros((CONTEXT, 2))]
        return np.concatenate([np.concatenate([x, s[:, None], m], axis=1) for x, s, m in zip((self.r, self.q, self.c), sizes, more, strict=True)])

    def load(self, rows: np.ndarray) -> None:
        rows = rows.astype(np.float32)
        ends = np.cumsum([len(self.r), len(self.q)])
        r, q, c = np.split(rows, ends)
        self.r, self.q, self.c, self.b = r[:, :WIDTH].copy(), q[:, :WIDTH].copy(), c[:, :WIDTH].copy(), q[:, WIDTH + 1].copy()
        self.sizes = [r[:, WIDTH].copy(), q[:, WIDTH].copy(), q[:, WIDTH + 2].copy(), c[:, WIDTH].copy()]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row."""
    return np.einsum("ij,ij->i", a, b)


def _sums(index: np.ndarray, gradient: np.ndarray, n: int) -> np.ndarray:
    """Sums of the gradients that fall on each of ``n`` parameter rows."""
    width = gradient.shape[1]
    cell = (index[:, None] * width + np.arange(width)).reshape(-1)
    return np.bincount(cell, gradient.reshape(-1), n * width).reshape(n, width).astype(np.float32)


class Lexicon:
    """The common words with what a text needs of them: symbol, log10(c + 1), whether c > 0, log10 of the share of its ending."""

    def __init__(self, words: list[bytes], counts: np.ndarray, model: list[bytes], masses: np.ndarray):
        self.index = {w: i for i, w in enumerate(words)}
        chosen = {w: i for i, w in enumerate(model)}
        self.symbol = np.array([chosen.get(w, -1) for w in words], dtype=np.int32)
        other = np.flatnonzero(self.symbol < 0)
        self.symbol[other] = [ending(words[i]) for i in other]
        self.log_count = np.log10(counts + 1.0)
        self.known = counts > 0
        #: log10 of Z by ending.
        self.masses = np.log10(masses)
        self.share = self.log_count - self.masses[np.clip(self.symbol - WORDS, 0, ENDINGS - 1)]
        self.share[self.symbol < WORDS] = 0

    def read(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """(symbols, common words or -1, the other words) of each piece of a text, without the end."""
        for words in pieces(text):
            at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
            symbols = self.symbol[at] if len(self.symbol) else np.zeros(len(at), np.int32)
            rare = np.flatnonzero(at < 0)
            others = [words[i] for i in rare]
            symbols[rare] = [ending(w) for w in others]
            yield symbols, at, others


def contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(context, target) of all tokens of texts given as symbols, ends added."""
    flat = np.concatenate([np.r_[START, START, t, END] for t in texts]).astype(np.int32)
    inside = np.ones(len(flat), dtype=bool)
    starts = np.r_[0, np.cumsum([len(t) + 3 for t in texts])[:-1]]
    inside[starts] = inside[starts + 1] = False
    at = np.flatnonzero(inside)
    return np.stack([flat[at - 1], flat[at - 2]], axis=1), flat[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, train, held): a task's counts, in parts of bounded size; the end is the empty word."""
    sides = (Counter(), Counter())

    def out() -> Iterator[pa.RecordBatch]:
        train, held = sides
        for words in ([*train], [w for w in held if w not in train]):
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train[w] for w in words]), pa.array([held[w] for w in words])], names=["word", "train", "held"])
        train.clear(), held.clear()

    for b in small(batches, ROWS):
        for text, apart in zip(b.column("text"), b.column("held_out").to_pylist(), strict=True):
            side = sides[apart]
            for words in pieces(text.as_py()):
                side.update(words)
            side[b""] += 1
            if len(side) > HELD:
                yield from out()
    yield from out()
    give_back()


def _learn(lexicon, start, order: int, most: int):
    """Trains on the texts of a task from ``start`` and gives parameter rows times tokens: the first time (``order`` 0) on ``most`` tokens, the
    texts over and over, then on each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = pickle.loads(lexicon.value), pickle.loads(start.value)
        rng = np.random.default_rng([order, TaskContext.get().partitionId()])

        def go_over(context: np.ndarray, target: np.ndarray, most: int) -> None:
            dealt = rng.permutation(len(target))[:most]
            for at in range(0, len(dealt), BATCH):
                pick = dealt[at : at + BATCH]
                model.train(context[pick], target[pick], rng)

        held = []
        for b in small(batches, ROWS):
            if order or sum(len(target) for _, target in held) < most:
                texts = [np.concatenate([s for s, _, _ in lex.read(t.as_py())]) for t in b.column("text")]
                context, target = contexts(texts)
                if order:
                    go_over(context, target, len(target))
                else:
                    held.append((context, target))
        if held:
            context, target = (np.concatenate(x) for x in zip(*held, strict=True))
            while model.tokens < most:
                go_over(context, target, most - model.tokens)
        if model.tokens:
            rows = model.rows()
            columns = [pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), float(model.tokens))), *[pa.array(x) for x in (rows * model.tokens).T]]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "tokens", *[f"x{i}" for i in range(rows.shape[1])]])
        give_back()

    return run


def _score(lexicon, learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, (model, normaliser) = pickle.loads(lexicon.value), pickle.loads(learned.value)
        ln10 = math.log(10)
        for b in small(batches, ROWS):
            n, known, base, score, sizes, rare, times = [], [], [], [], [0], [], []
            for text in b.column("text"):
                tokens, seen, logs, total, others, tail = 1, 0, 0.0, 0.0, Counter(), np.array([START, START])
                for symbols, at, words in lex.read(text.as_py()):
                    common = at[at >= 0]
                    tokens += len(at)
                    seen += int(lex.known[common].sum())
                    logs += float(lex.log_count[common].sum())
                    total += float(lex.share[common].sum())
                    others.update(words)
                    total -= float(lex.masses[symbols[at < 0] - WORDS].sum())
                    flat = np.r_[tail, symbols]
                    tail = flat[-2:]
                    for lo in range(2, len(flat), BATCH):
                        hi = min(lo + BATCH, len(flat))
                        total += float(model.log_probability(np.stack([flat[lo - 1 : hi - 1], flat[lo - 2 : hi - 2]], axis=1), flat[lo:hi], normaliser).sum(dtype=np.float64)) / ln10
                total += float(model.log_probability(np.array([[tail[1], tail[0]]]), np.array([END]), normaliser)[0]) / ln10
                n.append(tokens), known.append(seen), base.append(logs), score.append(total)
                rare += others.keys()
                times += others.values()
                sizes.append(len(rare))
            columns = [b.column("key"), b.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            words = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), words)], names=["key", "held_out", "n_tokens", "n_known", "logs", "score", "rare"])
        give_back()

    return run


def _normalise(learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(learned.value)
        for b in batches:
            last = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(model.normaliser(last)), pa.list_(pa.float32()))], names=["last", "sums"])

    return run


def _warm(rows: DataFrame, n: int) -> DataFrame:
    """About WARM_ROWS of ``n`` training rows, twice that at most, by a hash of key and text."""
    share = min(1.0, WARM_ROWS / max(n, 1))
    dealt = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) < int(share * (1 << 20))
    return rows.filter(dealt).limit(2 * WARM_ROWS).coalesce(1)


#: Where a word's count stands, train and held out together.
STEP = "CAST(floor(log2(train + held) * 16) AS INT)"


class Counted:
    """The corpus statistics: a table of counts by word, totals, and the common words."""

    def __init__(self, rows: DataFrame, path: str):
        spark = rows.sparkSession
        counted = rows.mapInArrow(_count, "word binary, train long, held long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("held").alias("held"))
        with tidy(spark):
            counted.write.parquet(path)
        self.table = spark.read.schema("word binary, train long, held long").parquet(path)
        total = self.table.agg(F.sum("train").alias("n"), F.sum((F.col("train") > 0).cast("long")).alias("v"), F.max(F.when(F.octet_length("word") == 0, F.col("train"))).alias("ends")).first()
        self.tokens, self.distinct, self.ends = (int(total[c] or 0) for c in ("n", "v", "ends"))
        words = self.table.filter(F.octet_length("word") > 0)
        # Counts in steps of a sixteenth of an octave: a thousand rows at most tell where the common words begin.
        per = sorted((r["step"], r["n"]) for r in words.groupBy(F.expr(STEP).alias("step")).agg(F.count("*").alias("n")).collect())
        self.least = per[-1][0] + 1 if per else 0
        room = COMMON
        for step, n in reversed(per):
            room -= n
            if room < 0:
                break
            self.least = step
        top = words.filter(F.expr(STEP) >= self.least).select("word", "train").toArrow()
        self.words, self.counts = top.column("word").to_pylist(), top.column("train").to_numpy().astype(np.int64)
        #: All words that are not common.
        self.rare = words.filter(F.expr(STEP) < self.least).select("word", "train")
        order = sorted(np.flatnonzero(self.counts).tolist(), key=lambda i: (-self.counts[i], self.words[i]))[:WORDS]
        self.model = [self.words[i] for i in order]
        by_class = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(ENDINGS)).cast("int")
        masses = np.ones(ENDINGS)
        tokens = np.zeros(ENDINGS)
        for r in words.filter("train > 0").groupBy(by_class.alias("ending")).agg(F.sum("train").alias("n"), F.count("*").alias("v")).collect():
            masses[r["ending"]] += r["n"] + r["v"]
            tokens[r["ending"]] += r["n"]
        for i in order:
            e = ending(self.words[i]) - WORDS
            masses[e] -= self.counts[i] + 1
            tokens[e] -= self.counts[i]
        self.masses = masses
        self.unigram = np.r_[self.counts[order], np.zeros(WORDS - len(order)), tokens, self.ends] + 0.5

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.counts, self.model, self.masses)


def fit(rows: DataFrame, counted: Counted, lexicon) -> Bilinear:
    """The model, trained on the rows (key, text) that are not held out: on the sample, then on all rows."""
    spark, model = rows.sparkSession, Bilinear(counted.unigram)
    if not counted.ends:
        return model
    width = model.rows().shape[1]
    schema = "row int, tokens double, " + ", ".join(f"x{i} double" for i in range(width))
    for order, source in enumerate((_warm(rows, counted.ends), rows)):
        learned = source.mapInArrow(_learn(lexicon, share(spark, model), order, TRAINED), schema)
        #: As many rows as the model has parameters' rows.
        mean = learned.groupBy("row").agg(*[(F.sum(f"x{i}") / F.sum("tokens")).alias(f"x{i}") for i in range(width)]).toArrow().sort_by("row")
        if mean.num_rows:
            model = Bilinear(counted.unigram)
            model.load(np.stack([c.to_numpy() for c in mean.columns[1:]], axis=1))
    return model


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")))
    counted = Counted(rows, scratch(spark, "words"))
    lexicon = share(spark, counted.lexicon())
    model = fit(rows.filter(~F.col("held_out")).select("key", "text"), counted, lexicon)
    handed = share(spark, model)
    sums = spark.range(0, SYMBOLS + 1, 1, min(SYMBOLS, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(_normalise(handed), "last long, sums array<float>").toArrow().sort_by("last")
    learned = share(spark, (model, sums.column("sums").combine_chunks().flatten().to_numpy().reshape(SYMBOLS + 1, -1)))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, rare array<struct<word: binary, n: long>>"
    path = scratch(spark, "scores")
    with tidy(spark):
        rows.mapInArrow(_score(lexicon, learned), schema).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    done = spark.read.schema(f"{schema}, row long").parquet(path)
    # A word that is not common stands in fewer rows than each of the common ones: no key is hot.
    rare = done.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counted.rare.filter("train > 0"), "word")
    rare = rare.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("train") + 1.0)).alias("rare_logs"))
    base = F.col("logs") + F.coalesce(F.col("rare_logs"), F.lit(0.0)) + math.log10(counted.ends + 1) - F.col("n_tokens") * math.log10(counted.tokens + counted.distinct + 1)
    return done.drop("rare").join(rare, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0)) + int(counted.ends > 0)).alias("n_known"),
        F.lit(counted.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("rare_logs", F.lit(0.0))).alias("score"),
    )


def op13_lm_scoring(spark, sf_dir):
    """Log probabilities of the whole documents."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
