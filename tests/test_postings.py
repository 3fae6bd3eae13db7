"""Postings by shelf and rankings by bounds: the same rows, fewer of them read."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, index
from tessera.runtime import scratch
from tessera.sources import tables


def rows(df):
    return sorted((r["qid"], r["pos"], r["ref"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """Units of very unlike lengths over words of very unlike frequencies; some empty, some without a ref, some twice the same."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(150)]
    text = lambda n: " ".join(words[int(150 * rng.random() ** 3)] for _ in range(n))
    units = [(i, text(rng.choice([0, 1, 3, 20, 200])), rng.choice([None, "", text(4)])) for i in range(700)]
    units += [(None, "w1 w2", "w3"), (900, units[5][1], units[5][2]), (901, units[5][1], units[5][2])]
    u = index.units(spark.createDataFrame(units, "ref int, body string, heading string"), "ref", ["body", "heading"])
    return index.build(u, scratch(spark, "postings-test"))


@pytest.mark.parametrize("weights", [None, {"heading": 3.0, "body": 0.5}])
@pytest.mark.parametrize("limit", [1, 10, 400])
def test_bounds_give_the_same_rows(spark, corpus, weights, limit):
    rng = random.Random(limit)
    asked = [(q, f"w{int(150 * rng.random() ** 2)}", rng.choice([1, 1, 2])) for q in range(25) for _ in range(rng.randint(1, 12))] + [(99, "nowhere", 1)]
    terms = spark.createDataFrame(asked, "qid int, tok string, times int").dropDuplicates(["qid", "tok"])
    want = rows(bm25.rank(bm25.score(corpus, terms, weights), limit))
    assert rows(bm25.top(corpus, terms, limit, weights, outright=0)) == want == rows(bm25.top(corpus, terms, limit, weights))


def test_a_third_of_the_postings_is_scored(spark):
    sf = "/root/testdata/sf0.01"
    ix, terms = tables.indexed(spark, sf, "bodies"), bm25.or_terms(tables.questions(spark, sf))
    b = bm25.bounded(ix, terms, 10)
    every = terms.join(ix.words, "tok").count()
    early = terms.join(b.later.select("qid", "tok"), ["qid", "tok"], "left_anti").join(ix.words, "tok").count()
    closed = b.near.join(b.open, ["qid", "block"], "left_anti").join(b.later, "qid").join(ix.words, ["tok", "ref"]).count()
    scanned = b.open.join(b.later, "qid").join(ix.words, ["tok", "block"]).count()
    print("postings", every, early, closed, scanned)
    assert early + closed + scanned < every / 2
    assert rows(bm25.top(ix, terms, 10, outright=0)) == rows(bm25.rank(bm25.score(ix, terms), 10))


def test_folders_are_pruned_by_the_shelves_asked(spark, corpus):
    terms = spark.createDataFrame([(1, "w3", 1, 2), (1, "w40", 1, 2)], "qid int, tok string, times int, n int")
    for ranked in (bm25.score(corpus, terms), bm25.score_all(corpus, terms), bm25.score(corpus, terms, pairs=True)):
        assert "dynamicpruning" in ranked._jdf.queryExecution().toString()
    read = corpus.words.join(F.broadcast(index.on_shelf(terms.select("tok"))), ["shelf", "tok"], "left_semi")
    assert len(read.collect()) == corpus.words.filter("tok in ('w3', 'w40')").count() > 0
    scan = [n for n in _nodes(read._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan parquet")]
    assert 0 < sum(n.metrics().apply("numFiles").value() for n in scan) <= len(corpus.words.inputFiles()) / 8


def _nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.finalPhysicalPlan()
    yield plan
    inner = [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    for child in inner:
        yield from _nodes(child)


def test_relations_of_the_index(spark, corpus):
    assert corpus.lengths.count() == 702 == corpus.totals.first()["units"]
    counted = corpus.words.groupBy("tok").agg(F.countDistinct("ref").alias("df"))
    assert counted.exceptAll(corpus.frequencies).count() == 0 == corpus.frequencies.exceptAll(counted).count()
    unit = corpus.words.groupBy("tok", "block", "ref", "len").agg(F.sum("n").alias("n")).groupBy("tok", "block").agg(F.count("*").alias("df"), F.max("n").alias("n"), F.min("len").alias("len"))
    assert unit.exceptAll(corpus.bounds.drop("shelf")).count() == 0
    assert corpus.words.filter("tok = '' OR tok LIKE '% %'").count() == 0 == corpus.pairs.filter("tok NOT LIKE '% %'").count()
