"""Language-model scoring: statistics against a plain version, normalised probabilities, training against the base."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm
from tessera.runtime import scratch

GAP = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string"


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in GAP.split(lowered) if w] + [None]


def apart(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def plain(docs):
    c = Counter(w for k, t in docs if not apart(k) for w in tokens(t))
    total, distinct = sum(c.values()), len(c)
    out = []
    for k, t in docs:
        w = tokens(t)
        out.append((k, apart(k), len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w)))
    return out


def counted(df):
    rows = df.select(F.col("doc_id").alias("key"), lm.held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return lm.Counted(rows, scratch(df.sparkSession, "words"))


def some(rng, n):
    words = ["the", "The", "É", "é", "of", "a\xa0b", "x" * 300, *(f"w{i}" for i in range(400))]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return [*docs, (None, "no id"), (None, None), (5, ""), (5, ""), (9, " \t\n"), (10, "unseen elsewhere\x0bhere"), (16, "q " * 3000)]


@pytest.mark.parametrize("common", [200_000, 40])
def test_statistics_against_plain(spark, monkeypatch, common):
    monkeypatch.setattr(lm, "COMMON", common)
    monkeypatch.setattr(lm, "TRAINED", 1000)
    docs = some(random.Random(common), 150)
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS key", "2 AS row", "3 AS word")
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in lm.scored(df).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    assert (len(counted(df).words) <= 40) == (common == 40)
    for a, b in zip(sorted(got, key=order), sorted(plain(docs), key=order), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)


def test_scores_are_those_of_the_model(spark, monkeypatch):
    """Common or rare, a word scores the same, and as the formula of the docstring says."""
    docs = some(random.Random(2), 120)
    df = spark.createDataFrame(docs, SCHEMA)
    model = lm.Bilinear(np.random.default_rng(1).random(lm.SYMBOLS) + 0.1, seed=4)
    monkeypatch.setattr(lm, "fit", lambda *_: model)
    monkeypatch.setattr(lm, "WORDS", 960)
    c = Counter(w for k, t in docs if not apart(k) for w in tokens(t))
    top = [w for w, _ in sorted(((w, n) for w, n in c.items() if w), key=lambda x: (-x[1], x[0].encode()))]
    chosen = {w: i for i, w in enumerate(top[: lm.WORDS])}
    z = Counter({i: 1 for i in range(lm.ENDINGS)})
    z.update({e: 0 for e in range(lm.ENDINGS)})
    symbol = lambda w: lm.END if w is None else chosen.get(w, lm.ending(w.encode()))
    for w, n in c.items():
        if w is not None and w not in chosen:
            z[lm.ending(w.encode()) - lm.WORDS] += n + 1
    sums = np.log(np.exp(np.array([[(model.c[0] * model.r[a] + model.c[1] * model.r[b]) @ model.q.T + model.b for b in range(0, lm.SYMBOLS + 1)] for a in range(0, lm.SYMBOLS + 1, 331)], np.float64)).sum(axis=2))
    assert np.allclose(model.normaliser(np.arange(0, lm.SYMBOLS + 1, 331)), sums, atol=1e-3)

    def expected(text):
        total, last = 0.0, (lm.START, lm.START)
        for w in tokens(text):
            s = symbol(w)
            scores = (model.c[0] * model.r[last[0]] + model.c[1] * model.r[last[1]]).astype(np.float64) @ model.q.T + model.b
            total += (scores[s] - np.log(np.exp(scores).sum())) / math.log(10)
            if lm.WORDS <= s < lm.END:
                total += math.log10((c[w] + 1) / z[s - lm.WORDS])
            last = (s, last[0])
        return total

    for common in (200_000, 30):
        monkeypatch.setattr(lm, "COMMON", common)
        monkeypatch.setattr(lm, "BATCH", 16)
        if common == 30:
            # Of fewer common words the model has fewer words.
            chosen = {w.decode(): i for i, w in enumerate(counted(df).model)}
            assert 0 < len(chosen) < 30
            z = Counter(dict.fromkeys(range(lm.ENDINGS), 1))
            for w, n in c.items():
                if w is not None and w not in chosen:
                    z[lm.ending(w.encode()) - lm.WORDS] += n + 1
        got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.scored(df).collect()}
        for k, t in docs:
            assert got[k, len(tokens(t))] == pytest.approx(expected(t), rel=1e-4, abs=1e-3)


def test_training_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(8)
    tongues = [[f"{x}{i}" for i in range(300)] for x in "ab"]
    docs = []
    for i in range(1500):
        w = tongues[i % 2]
        docs.append((i, " ".join(w[int(300 * rng.random() ** 3)] for _ in range(60))))
    got = lm.scored(spark.createDataFrame(docs, SCHEMA)).filter("held_out").selectExpr("sum(score) AS a", "sum(base_score) AS b", "sum(n_tokens) AS n").first()
    # Of two languages that never mix, the one before tells the one to come: log10(2) a token is there to gain.
    assert (got["a"] - got["b"]) / got["n"] > 0.2


def test_gradient_follows_the_objective():
    """A step on a batch raises the noise-contrastive objective of that batch."""
    rng = np.random.default_rng(0)
    model = lm.Bilinear(rng.random(lm.SYMBOLS) + 0.01)
    context, target = rng.integers(0, lm.SYMBOLS, (500, 2)), rng.integers(0, 40, 500)
    before = model.log_probability(context, target, model.normaliser(np.arange(lm.SYMBOLS + 1))).mean()
    for _ in range(30):
        model.train(context, target, rng)
    assert model.log_probability(context, target, model.normaliser(np.arange(lm.SYMBOLS + 1))).mean() > before + 0.5
    assert np.allclose(lm.Bilinear(model.noise).rows().shape, model.rows().shape)
    other = lm.Bilinear(model.noise)
    other.load(model.rows())
    assert all(np.allclose(x, y) for x, y in zip((model.r, model.q, model.c, model.b, *model.sizes), (other.r, other.q, other.c, other.b, *other.sizes), strict=True))


def test_no_rows_and_no_training_rows(spark):
    assert lm.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    key = next(k for k in range(100) if apart(k))
    r = lm.scored(spark.createDataFrame([(key, "one two")], SCHEMA)).first()
    assert r["held_out"] and r["n_tokens"] == 3 and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] < 0


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 7)
    text = b"aa BB\tccc  dddddddddddddddddd e \n" * 9
    assert [w for p in lm.pieces(text) for w in p] == text.lower().split()
    assert list(lm.pieces(b"")) == [[]]


def test_training_is_the_same_for_any_size(spark, monkeypatch):
    """However few or many tokens there are, a start of TRAINED tokens and one pass over all rows."""
    seen, shared = [], lm._learn
    monkeypatch.setattr(lm, "TRAINED", 2000)
    monkeypatch.setattr(lm, "_learn", lambda lexicon, start, order, most: (seen.append((order, most)), shared(lexicon, start, order, most))[1])
    for n in (3, 60, 600):
        docs = spark.createDataFrame([(i, "one two three four") for i in range(n)], SCHEMA)
        assert lm.scored(docs).count() == n
    assert seen == [(0, 2000), (1, 2000)] * 3
    lexicon, model = lm.Lexicon([b"one"], np.array([3]), [b"one"], np.ones(lm.ENDINGS)), lm.Bilinear(np.ones(lm.SYMBOLS))
    rows = spark.createDataFrame([(i, b"one one one") for i in range(10)], "key long, text binary").coalesce(1)
    tokens = lambda order: rows.mapInArrow(shared(lm.share(spark, lexicon), lm.share(spark, model), order, 2000), "row int, tokens double, " + ", ".join(f"x{i} double" for i in range(lm.WIDTH + 3))).first()["tokens"]
    assert (tokens(0), tokens(1)) == (2000, 40)


def test_noise_is_drawn_from_shares_cumulated_once():
    """A step draws what choice by the shares would draw, and a second step cumulates nothing again."""
    model = lm.Bilinear(np.random.default_rng(2).random(lm.SYMBOLS) + 0.1)
    context, target = np.zeros((4, lm.CONTEXT), np.int32), np.arange(4)
    model.train(context, target, np.random.default_rng(5))
    kept = model.cdf
    model.train(context, target, np.random.default_rng(6))
    assert model.cdf is kept
    drawn = kept.searchsorted(np.random.default_rng(7).random(lm.NOISE), side="right")
    assert np.array_equal(drawn, np.random.default_rng(7).choice(lm.SYMBOLS, lm.NOISE, p=model.noise))
