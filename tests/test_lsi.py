"""The learned encoder against a plain decomposition, and what it finds."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import lsi
from tessera.plans import catalogue


def plain(texts, words, k):
    """The leading right singular vectors of the weighted counts."""
    told = [Counter(t.split()) for t in texts]
    df = Counter(w for t in told for w in t)
    a = np.array([[(1 + math.log(t[w])) * max(math.log((len(texts) + 1) / (df[w] + 1)), 1e-6) if t[w] else 0.0 for w in words] for t in told])
    size = np.sqrt((a * a).sum(axis=1, keepdims=True))
    return np.linalg.svd(a / np.where(size > 0, size, 1))[2][:k].T


def test_block_iteration_finds_the_singular_vectors(spark):
    rng = random.Random(6)
    topics = [[f"t{k}w{i}" for i in range(8)] for k in range(3)]
    # Topics of unlike sizes, so that their directions are told apart.
    texts = [" ".join(rng.choice(topics[k]) for _ in range(rng.randint(4, 20))) for k in range(3) for _ in range(30 * (k + 1))] + ["", " ", "alone"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    p = lsi.fit(df, dimensions=3, passes=30, share=1.0)
    words = sorted(p.place, key=p.place.get)
    want = plain([*texts, ""], words, 3)
    # The same space: all principal angles are zero.
    assert np.allclose(np.linalg.svd(p.block.T @ want)[1], 1, atol=1e-4)
    got = [r[0] for r in spark.createDataFrame([("t0w1 t0w2",), ("t0w5",), ("t2w1",), ("unknown",), (None,)], "text string").select(lsi.encoder(p, spark)(F.col("text"))).collect()]
    assert np.dot(got[0], got[1]) > 0.9 and abs(np.dot(got[0], got[2])) < 0.3 and got[3] is None and got[4] is None


def test_bounds_and_empty_corpora(spark):
    df = spark.createDataFrame([("a b",), ("b c",), ("c b a",)], "text string")
    assert lsi.fit(df, dimensions=10, passes=2, share=1.0).block.shape[1] <= 3
    assert set(lsi.fit(df, vocabulary=2, passes=1, share=1.0).place) == {"a", "b"}
    with pytest.raises(ValueError):
        lsi.fit(df.limit(0))


def test_it_finds_more_than_hashed_words(spark):
    got = {r["encoder"]: r for r in catalogue.queries()["encoder_recall"](spark, "/root/testdata/sf0.01").collect()}
    print(got)
    assert got["learned"]["n"] == got["hashed"]["n"] > 10
    assert got["learned"]["r10"] > got["hashed"]["r10"] and got["learned"]["mrr"] > got["hashed"]["mrr"]
