"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of fixed lexicons (insults, profanity, threats) and of a
learned one, the share of lexicon hits near a second-person pronoun, capitals, punctuation
and obfuscation rates, and the length. The learned lexicon weighs words and word beginnings
by the log ratio of their rates in toxic and clean training texts.

Training uses at most ``sample_rows`` labelled rows (a documented bound), the same ones for
the same table: those with the smallest hash. They are split in folds by crc32(key) mod 5.
The features of a training row come from lexicon weights that its own fold had no part in (which tokens
are weighed is chosen on all training folds), and the
calibration is fitted on scores of trees that did not see the row's fold. The trees are
small and fitted on the driver from that bounded sample; scoring is one pass over all rows.

Cases: null and empty texts have all-zero features and get the score of those; repeated
label rows of a key count once, as toxic if any says so, null labels not at all; a labelled key of several texts trains with one of them; labels of
keys without a text do not take part; without labels of both classes a fixed rule stands in
(lexicon density on a logistic curve); ties of the sample's order fall back on the key; texts of equal
margin get equal scores, and equal margins are one point of the calibration; a very long text is scored
whole, in memory linear in its length; an empty table gives an empty result; other columns of the input do not
take part, and columns named as the added ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.workers import give_back, small
from tessera.runtime import cut

#: Lexicons and second-person pronouns.
INSULTS = frozenset(
    """idiot idiots moron morons stupid dumb loser losers scum trash garbage clown clowns pathetic worthless disgusting
    fool fools imbecile cretin jerk pig pigs rat vermin filth filthy coward cowards liar liars freak creep ugly useless
    idiota imbécil estúpido estúpida basura asqueroso inútil idiote imbécile crétin débile ordure minable dégoûtant
    idiotin trottel dummkopf blöd abschaum widerlich wertlos versager""".split()
)
PROFANITY = frozenset("ass asshole bastard bitch crap damn dick fuck fucked fucker fucking hell piss shit shitty slut whore merde putain connard salope scheiße arschloch mierda puta cabrón joder".split())
THREATS = frozenset("kill die dead hate hang shoot stab burn beat destroy hurt murder rape tuer mourir crever sterben töten umbringen hasse matar morir odio".split())
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer ti tú vos usted ustedes tuyo".split())
UNMASK = str.maketrans("013457@$!|+", "oieastasiit")
NEAR = 5
STEMS = (5, 7)
FOLDS = 5
SAMPLE_ROWS = 8000
#: Rows that are scored at once.
ROWS = 1000
TOKENS = 5000
NAMES = ("insult", "profanity", "threat", "learned", "learned_hits", "learned_max", "second_near", "capitals", "shouted", "exclaims", "punctuation", "obfuscated", "unmasked", "spaced", "log_words")

_WORD = re.compile(r"[^\W\d_]+")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_PUNCT = re.compile(r"[^\w\s]")
_MASKED = re.compile(r"[^\W\d_]+(?:[0-9@$!|+*#]+[^\W\d_]+)+")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .\-]){3,}[^\W\d_]\b")


def features(text: str | None, weights: dict[str, float]) -> list[float]:
    """The dense features of one text; all rates are per word or per character."""
    t = text or ""
    if not t:
        return [0.0] * len(NAMES)
    w = _WORD.findall(t.lower())
    n = max(1, len(w))
    a, b = STEMS
    get = weights.get
    hits, insult, profane, threat, learned, most, many = [], 0, 0, 0, 0.0, 0.0, 0
    for i, x in enumerate(w):
        g = get(x, 0.0)
        if len(x) >= a:
            g = max(g, get(x[:a] + "*", 0.0))
            if len(x) >= b:
                g = max(g, get(x[:b] + "*", 0.0))
        if g:
            learned += g
            many += 1
            most = max(most, g)
        if x in INSULTS:
            insult += 1
            hits.append(i)
        elif x in PROFANITY:
            profane += 1
            hits.append(i)
        elif x in THREATS:
            threat += 1
            hits.append(i)
    near = sum(any(y in SECOND for y in w[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    masked = _MASKED.findall(t)
    unmasked = sum(m.lower().translate(UNMASK) in INSULTS or m.lower().translate(UNMASK) in PROFANITY for m in masked)
    spaced = sum(re.sub(r"[ .\-]", "", m).lower() in INSULTS for m in _SPACED.findall(t))
    c = len(t)
    return [
        insult / n, profane / n, threat / n, learned / n, many / n, most, near / len(hits) if hits else 0.0, len(_CAPITAL.findall(t)) / c,
        len(_SHOUT.findall(t)) / n, t.count("!") / c, len(_PUNCT.findall(t)) / c, len(masked) / n, unmasked / n, spaced / n, math.log1p(len(w)),
    ]


class Boosted:
    """Binary trees of fixed depth on quantile bins, fitted to the logistic loss with second-order gains."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.prior, self.fitted = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        least = min(max(len(y) / 1000, 0.3), 2.0)  # the curvature that a leaf needs: few rows must do with less
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.prior = math.log(p / (1 - p))
        f = np.full(len(y), self.prior)
        width = max(len(e) for e in edges) + 1
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            node, feature, cutoff = np.zeros(len(y), dtype=np.int64), [], []
            for level in range(self.depth):
                k = 1 << level
                best = np.full(k, 1e-6)
                pick, at = np.zeros(k, dtype=np.int64), np.full(k, np.inf)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    cell = node * width + code[:, j]
                    gl = np.bincount(cell, g, k * width).reshape(k, width)
                    hl = np.bincount(cell, h, k * width).reshape(k, width)
                    gt, ht = gl.sum(1, keepdims=True), hl.sum(1, keepdims=True)
                    gl, hl = gl.cumsum(1)[:, : len(e)], hl.cumsum(1)[:, : len(e)]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain = np.where((hl >= least) & (ht - hl >= least), gain, 0)
                    top = gain.argmax(1)
                    better = gain[np.arange(k), top] > best
                    best = np.where(better, gain[np.arange(k), top], best)
                    pick, at = np.where(better, j, pick), np.where(better, e[top], at)
                feature.append(pick)
                cutoff.append(at)
                node = 2 * node + (x[np.arange(len(y)), pick[node]] > at[node])
            k = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, k) / (np.bincount(node, h, k) + self.ridge)
            f += leaf[node]
            self.fitted.append((feature, cutoff, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.prior)
        row = np.arange(len(x))
        for feature, cutoff, leaf in self.fitted:
            node = np.zeros(len(x), dtype=np.int64)
            for pick, at in zip(feature, cutoff, strict=True):
                node = 2 * node + (x[row, pick[node]] > at[node])
            f += leaf[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, rising probabilities) to interpolate between. Equal scores are
    one observation with their labels' mean, however the rows stand."""
    values, at = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # sum of labels, count, sum of scores
    for s, label, n in zip(values, np.bincount(at, y), np.bincount(at).astype(float), strict=True):
        blocks.append([label, n, s * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([s / n for _, n, s in blocks]), np.array([p / n for p, n, _ in blocks])


class Model:
    """Lexicon weights, trees and calibration; ``score`` is the calibrated margin, in 0 to 1."""

    def __init__(self, weights: dict[str, float], trees: Boosted | None, knots: tuple[np.ndarray, np.ndarray] | None):
        self.weights, self.trees, self.knots = weights, trees, knots

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The raw score, in log odds."""
        return 400 * (x[:, 0] + x[:, 1]) - 4 if self.trees is None else self.trees.margin(x)

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return 1 / (1 + np.exp(-m)) if self.knots is None else np.interp(m, *self.knots)


def _log_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 1.5) / (n_clean + 1))


def _lexicons(words: DataFrame) -> list[dict[str, float]]:
    """Weights by fold left out (index 0: none), from (word, fold, toxic, n). At most ``TOKENS`` tokens are collected."""
    totals = {(r["fold"], r["toxic"]): float(r["n"]) for r in words.groupBy("fold", "toxic").agg(F.sum("n").alias("n")).collect()}
    stems = [F.when(F.char_length("word") >= k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS]
    tokens = words.withColumn("token", F.explode(F.array_compact(F.array(F.col("word"), *stems))))
    cell = lambda f, t: F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"c{f}{t}")
    per = tokens.groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"), *[cell(f, t) for f in range(1, FOLDS) for t in (0, 1)])
    share = sum(v for (_, t), v in totals.items() if t == 1) / max(1.0, sum(totals.values()))
    over = F.col("t") / F.sqrt((F.col("t") + F.col("c")) * F.lit(share) + 1)
    top = per.filter((F.col("t") >= 5) & (F.col("t") > 3 * share * (F.col("t") + F.col("c")))).orderBy(over.desc(), "token").limit(TOKENS).collect()
    out = []
    for left in range(FOLDS):
        use = [f for f in range(1, FOLDS) if f != left]
        toxic = np.array([sum(r[f"c{f}1"] for f in use) for r in top], dtype=float)
        clean = np.array([sum(r[f"c{f}0"] for f in use) for r in top], dtype=float)
        ratio = _log_ratio(toxic, clean, sum(totals.get((f, 1), 0.0) for f in use), sum(totals.get((f, 0), 0.0) for f in use))
        out.append({r["token"]: float(v) for r, v, t in zip(top, ratio, toxic, strict=True) if v > math.log(3) and t >= 4})
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits the model to at most ``sample_rows`` labelled rows whose crc32(key) mod 5 is not 0."""
    fold = F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).dropna().groupBy("key").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", fold).filter("fold <> 0").orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).dropna()
    # The broadcast side holds at most sample_rows small rows; of the texts of a repeated key the one of the least hash stands for it.
    drawn = rows.join(F.broadcast(known), "key").groupBy("key", "toxic", "fold").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"))
    sample = cut(drawn.select("key", "toxic", "fold", "one.text").repartition(24))
    cells = sample.select("fold", "toxic", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    lexicons = _lexicons(cut(cells.groupBy("word", "fold", "toxic").agg(F.count("*").alias("n"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            x = [features(t, lexicons[f]) for t, f in zip(d["text"], d["fold"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["fold", "toxic", "x"])

    got = sample.select("fold", "toxic", "text").mapInArrow(run, "fold int, toxic int, x array<double>").orderBy("fold", "toxic", "x").collect()
    if len({r["toxic"] for r in got}) < 2:
        return Model(lexicons[0], None, None)
    x, y, f = np.array([r["x"] for r in got]), np.array([float(r["toxic"]) for r in got]), np.array([r["fold"] for r in got])
    apart = np.zeros(len(y))
    for k in range(1, FOLDS):
        if (f == k).any():
            rest = f != k
            apart[f == k] = Boosted().fit(x[rest], y[rest]).margin(x[f == k]) if len(set(y[rest])) == 2 else 0.0
    return Model(lexicons[0], Boosted().fit(x, y), isotonic(apart, y))


def scored(docs: DataFrame, model: Model, text: str = "text", margin: str | None = None) -> DataFrame:
    """``docs`` with a column ``score`` and, if named, one of raw margins (replacing those of the names), in one pass."""
    added = ["score"] if margin is None else ["score", margin]
    rows = docs.drop(*added)
    at = rows.columns.index(text)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, ROWS):
            x = np.array([features(t.as_py(), model.weights) for t in b.column(at)], dtype=float).reshape(-1, len(NAMES))
            got = [pa.array(np.clip(model.score(x), 0, 1)), pa.array(model.margin(x))][: len(added)]
            yield pa.RecordBatch.from_arrays([*b.columns, *got], names=[*b.schema.names, *added])
        give_back()

    return rows.mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir):
    """Toxicity score of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = scored(docs, train(docs, labels), margin="margin")
    told = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return out.select("doc_id", (F.crc32(told) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "margin")
