"""A scorer of (question, text) pairs that is learned from gold answers.

Five features tell how a text matches: the share of the question's distinct words that it holds, the share of its pairs of following words, the longest run of
its words that stand in a row, how dense its words are, and the length. Weights come from pairwise logistic regression: of two candidates of a question, one right and one
not, the right one is to score higher. Each question weighs the same however many pairs it has.

Bounds: the fit takes every question that can teach. Their candidates (a ranking's cut, some 32 each), five numbers a candidate, stay in tasks, a row a question; each step of the fit is a pass
in which a task adds up loss, gradient and curvature, and those few numbers of each task come to the driver. Everything else is a row's own work in Arrow batches. Cases: an empty or null question or text has features of zero; questions without a right or without a wrong candidate teach
nothing; without any that teach, the weights are those of word overlap alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.rerank import Scorer
from tessera.runtime import cut

#: Weight of the squared weights beside the mean loss.
RIDGE = 1e-3
FEATURES = ("words", "pairs", "run", "density", "length")


def features(q: list[str], t: list[str]) -> list[float]:
    """How the words ``t`` of a text match the words ``q`` of a question."""
    if not q or not t:
        return [0.0] * len(FEATURES)
    asked = dict.fromkeys(q)
    at: dict[str, list[int]] = {w: [] for w in asked}
    for i, w in enumerate(t):
        if w in at:
            at[w].append(i)
    longest, pairs, ends = 0, {}, {}
    for k, w in enumerate(q):
        ends = {i: ends.get(i - 1, 0) + 1 for i in at[w]}
        longest = max([longest, *ends.values()])
        if k:
            pairs[q[k - 1], w] = any(n > 1 for n in ends.values())
    held = sum(map(len, at.values()))
    return [
        sum(1 for w in asked if at[w]) / len(asked),
        sum(pairs.values()) / len(pairs) if pairs else 0.0,
        longest / len(q),
        held / len(t),
        float(np.log1p(len(t))) / 10,
    ]


def _split(texts: pd.Series) -> list[list[str]]:
    return [x.split() if isinstance(x, str) else [] for x in texts]


def _words(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def matched(query: Column, text: Column) -> Column:
    """The features of a pair, as an array."""

    @F.pandas_udf("array<double>")
    def told(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            yield pd.Series([features(a, b) for a, b in zip(_split(q), _split(t), strict=True)])

    return told(_words(query), _words(text))


def _gaps(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Every right candidate's features less every wrong one's."""
    return (good[:, None, :] - bad[None, :, :]).reshape(-1, good.shape[1])


def _sums(d: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature at ``w`` of gaps ``d`` that weigh ``v``, in one row."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
    return np.concatenate([[v @ np.logaddexp(0, -d @ w)], -d.T @ (v * p), ((d * (v * p * (1 - p))[:, None]).T @ d).ravel()])


def newton(told: Callable[[np.ndarray], np.ndarray], size: int, ridge: float, steps: int = 30) -> np.ndarray:
    """The weights of least loss, by Newton steps that are halved while they lead up; ``told`` gives ``_sums`` over all questions, a mean."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = told(w)
        return float(s[0] + ridge * w @ w), s[1 : 1 + size] + 2 * ridge * w, s[1 + size :].reshape(size, size) + 2 * ridge * np.eye(size)

    w = np.zeros(size)
    loss, grad, curve = at(w)
    for _ in range(steps):
        step = np.linalg.solve(curve, grad)
        share, there = 1.0, at(w - step)
        while there[0] > loss and share > 1e-6:
            share /= 2
            there = at(w - share * step)
        w, (loss, grad, curve) = w - share * step, there
        if np.abs(step).max() < 1e-9:
            break
    return w


def _overlap(size: int) -> np.ndarray:
    """The weights where nothing teaches: word overlap alone."""
    return np.eye(size)[0]


def pairwise(x: np.ndarray, right: np.ndarray, question: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Weights by Newton steps on the logistic loss of right less wrong candidates, a question's mean each."""
    gaps, weight = [], []
    for q in np.unique(question):
        good, bad = x[(question == q) & right], x[(question == q) & ~right]
        if len(good) and len(bad):
            d = _gaps(good, bad)
            gaps.append(d)
            weight.append(np.full(len(d), 1 / len(d)))
    if not gaps:
        return _overlap(x.shape[1] if x.ndim == 2 else len(FEATURES))
    d, v = np.concatenate(gaps), np.concatenate(weight) / len(gaps)
    return newton(lambda w: _sums(d, v, w), d.shape[1], ridge, steps)


@dataclass(frozen=True)
class Learned:
    weights: tuple[float, ...]

    def scorer(self) -> Scorer:
        weights = np.array(self.weights)

        @F.pandas_udf("double")
        def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, t in parts:
                rows = [features(a, b) for a, b in zip(_split(q), _split(t), strict=True)]
                yield pd.Series(np.array(rows).reshape(len(rows), len(weights)) @ weights)

        return lambda query, text: scored(_words(query), _words(text))


def _summed(taught: DataFrame, w: np.ndarray) -> np.ndarray:
    """``_sums`` at ``w`` over all questions of ``taught`` (good, bad: the features of candidates), added up in each task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = None
        for b in batches:
            for good, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = _gaps(np.array(good, dtype=float), np.array(bad, dtype=float))
                own = _sums(d, np.full(len(d), 1 / len(d)), w)
                told = own if told is None else told + own
        if told is not None:
            yield pa.RecordBatch.from_arrays([pa.array([told.tolist()], pa.list_(pa.float64()))], names=["s"])

    # A row of 1 + 5 + 25 numbers from each task, in an order that does not depend on which ends first.
    return np.array(taught.mapInArrow(part, "s array<double>").toArrow().column("s").to_pylist(), dtype=float).sum(axis=0)


def fit(pairs: DataFrame, questions: int | None = None, ridge: float = RIDGE) -> Learned:
    """The scorer that ``pairs`` (qid, query, text, right: whether the text answers) teach, all questions of them or, where a number is asked for, the
    ``questions`` of the least hash."""
    able = pairs.groupBy("qid").agg(F.max("right").alias("some"), F.min("right").alias("every")).filter("some AND NOT every").select("qid")
    if questions is not None:
        able = able.orderBy(F.xxhash64("qid"), "qid").limit(questions)
    told = pairs.join(able, "qid").select("qid", "right", matched(F.col("query"), F.col("text")).alias("x"))
    side = lambda right: F.collect_list(F.when(F.col("right") == right, F.col("x")))
    taught = cut(told.groupBy("qid").agg(side(True).alias("good"), side(False).alias("bad")).select("good", "bad"))
    n = taught.count()
    w = newton(lambda at: _summed(taught, at) / n, len(FEATURES), ridge) if n else _overlap(len(FEATURES))
    return Learned(tuple(float(c) for c in w))
