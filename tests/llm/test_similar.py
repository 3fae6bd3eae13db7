"""The near-dedup stage of the pipeline against all pairs of shingle sets."""

import itertools

import numpy as np
import pytest

from tessera.llm import pipeline, simhash, similar


def brute(rows):
    """The smallest id of each component of texts whose 5-word shingle sets are at 0.8 or more."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted({find(i) for i in sets})


def changed(rng, words, n):
    out = list(words)
    for k in rng.choice(len(out), n, replace=False):
        out[k] = f"new{rng.integers(1 << 30)}"
    return out


@pytest.mark.parametrize("limit", [512, 4])
def test_near_copies_go(spark, limit):
    rng = np.random.default_rng(1)
    texts = ["", " \n", "two words", "Two  words", "a b c d e"]
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 3000, 300)]
        texts += [" ".join(base)] + [" ".join(changed(rng, base, n)) for n in (1, 2, 4, 6, 8, 10, 12, 20)]
        # A chain: each is like its neighbours, the ends are not like each other.
        for _ in range(6):
            base = changed(rng, base, 5)
            texts.append(" ".join(base))
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[k]) for i, k in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in similar.one_of_each(docs, limit=limit).collect())
    assert got == brute(rows) and len(got) < len(rows) / 2


def test_stage_drops_every_near_copy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, sf).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(None, "same words in here"), (4, "same words in here"), (4, "same words in here"), (4, "other"), (3, None), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in similar.one_of_each(docs).collect()), key=str)
    assert got == [(3, None), (4, "other"), (4, "same words in here"), (None, "alone")]
    assert similar.one_of_each(docs.limit(0)).count() == 0


def test_close_fingerprints_are_candidates(spark):
    """Texts that share no band are linked by the covering of their fingerprints, where the sets allow it."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 3000, 400)]
    fp = simhash.fingerprint(" ".join(base))
    copies = (" ".join(changed(rng, base, 1)) for _ in range(500))
    by_bits = {(simhash.fingerprint(t) ^ fp).bit_count(): t for t in copies}
    near, equal = by_bits[2], by_bits[0]
    # The last one's fingerprint is given as that of the first; its set is not like it.
    given = [(1, fp, " ".join(base)), (2, simhash.fingerprint(near), near), (3, fp, equal), (4, fp, "other words of no common shingle")]
    signed = lambda x: int(np.uint64(x).view(np.int64))
    marked = spark.createDataFrame([(h, signed(f), [1000 + h]) for h, f, _ in given], "h long, fp long, bands array<long>")
    texts = spark.createDataFrame([(h, t) for h, _, t in given], "h long, text string")
    assert sorted((r["node"], r["root"]) for r in similar.links(texts, marked).collect()) == [(1, 1), (2, 1), (3, 1)]
