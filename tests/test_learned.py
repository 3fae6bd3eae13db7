"""The learned scorer: features against plain versions, weights against a plain descent, order of held-out questions."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import learned, rerank


def plain(q, t):
    if not q or not t:
        return [0.0] * 5
    pairs = {(a, b) for a, b in zip(q, q[1:])}
    runs = [k for i in range(len(q)) for k in range(1, len(q) - i + 1) if any(t[j : j + k] == q[i : i + k] for j in range(len(t)))]
    return [
        len(set(q) & set(t)) / len(set(q)), len(pairs & set(zip(t, t[1:]))) / len(pairs) if pairs else 0.0, max([0, *runs]) / len(q),
        sum(w in q for w in t) / len(t), np.log1p(len(t)) / 10,
    ]


def test_features_are_those_of_a_plain_version():
    rng = random.Random(1)
    words = lambda n: [rng.choice("abcd") for _ in range(rng.randint(0, n))]
    for _ in range(500):
        q, t = words(7), words(12)
        assert np.allclose(learned.features(q, t), plain(q, t)), (q, t)


def test_weights_are_at_the_least_loss():
    rng = np.random.default_rng(2)
    x, question = rng.normal(size=(200, 5)), np.repeat(np.arange(20), 10)
    right = (x[:, 1] + 0.5 * rng.normal(size=200)) > 0.8
    w = learned.pairwise(x, right, question)

    def loss(w):
        parts = []
        for q in range(20):
            good, bad = x[(question == q) & right], x[(question == q) & ~right]
            if len(good) and len(bad):
                parts.append(np.mean([np.logaddexp(0, -(a - b) @ w) for a in good for b in bad]))
        return np.mean(parts) + learned.RIDGE * w @ w

    assert all(loss(w) <= loss(w + 1e-3 * e * s) + 1e-12 for e in np.eye(5) for s in (1, -1))
    assert w[1] == max(w)
    assert list(learned.pairwise(x, np.zeros(200, bool), question)) == [1, 0, 0, 0, 0]
    assert list(learned.pairwise(np.empty((0, 5)), np.zeros(0, bool), np.zeros(0))) == [1, 0, 0, 0, 0]


def test_held_out_questions(spark):
    """The right text holds the question's words in a row, the wrong ones each of them elsewhere: overlap cannot tell."""
    rng = random.Random(4)
    rows = []
    for qid in range(30):
        q = [f"w{rng.randint(0, 99)}x{k}" for k in range(4)]
        fill = lambda n: [rng.choice("một hai ba bốn".split()) for _ in range(n)]
        rows.append((qid, 900 + qid, 6, " ".join(q), " ".join([*fill(9), *q, *fill(9)]), True))
        for ref in range(5):
            mixed = [w for p in zip(rng.sample(q, 4), fill(4)) for w in p]
            rows.append((qid, ref, ref + 1, " ".join(q), " ".join(mixed + fill(10)), False))
    rows += [(99, 1, 1, None, "x", False), (99, 2, 2, "", None, True), (98, 1, 1, "a b", "a b", True)]
    pairs = spark.createDataFrame(pd.DataFrame(rows, columns=["qid", "ref", "pos", "query", "text", "right"]))
    scorer = learned.fit(pairs.filter("qid % 2 = 0"), questions=10).scorer()
    rest = pairs.filter("qid % 2 = 1").withColumn("title", F.lit(""))
    asked = rest.select("qid", F.col("query").alias("text")).distinct()
    first = lambda s: {r["qid"]: r["ref"] for r in rerank.rerank(rest.drop("query", "right"), asked, 32, 1, s, view=lambda _, t: t).collect()}
    best = first(scorer)
    assert all(best[q] == 900 + q for q in range(1, 30, 2))
    assert sum(first(rerank.lexical)[q] == 900 + q for q in range(1, 30, 2)) == 0
    assert learned.fit(pairs.limit(0)).weights == (1, 0, 0, 0, 0)


def test_more_than_overlap_on_given_questions(spark):
    from tessera.plans import catalogue

    got = {r["scorer"]: r["mrr"] for r in catalogue.queries()["learned_rerank_recall"](spark, "/root/testdata/sf0.1").collect()}
    assert got["learned"] > got["overlap"] > got["ranking"]


def test_every_question_teaches(spark):
    """More questions than a driver's sample would hold, of which the few of greatest hash tell otherwise: the weights are those of all."""
    rng = random.Random(7)
    rows = []
    for qid in range(2300):
        words = [f"w{rng.randint(0, 9)}" for _ in range(4)]
        for k in range(3):
            text = rng.sample(words, rng.randint(0, 4)) + [f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 6))]
            rows.append((qid, " ".join(words), " ".join(text), k == qid % 3))
    pairs = spark.createDataFrame(pd.DataFrame(rows, columns=["qid", "query", "text", "right"]))
    x = np.array([learned.features(q.split(), t.split()) for _, q, t, _ in rows])
    right, question = np.array([r[3] for r in rows]), np.array([r[0] for r in rows])
    assert np.allclose(learned.fit(pairs).weights, learned.pairwise(x, right, question), atol=1e-7)
