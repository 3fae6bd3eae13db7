"""The pipeline against a plain version, stage by stage, and the queries against their SQL."""

import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from tessera.llm import pipeline as corpus_pipeline
from tessera.llm import queries, segment, toxicity
from tests.compare import connect, differences
from tests.llm.test_similar import brute
from tests.llm.test_table_ops import brute_targets, words

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage over the smallest documents."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        made = spark.read.parquet(f"{base}/{name}")
        out.append((docs, made))
        docs = made
    return out


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"))
    rows = before.select(*corpus_pipeline.COLUMNS).collect()
    s = model.score(np.array([toxicity.features(r["text"], model.weights) for r in rows]))
    assert rows_of(after) == sorted((tuple(r) for r, x in zip(rows, s, strict=True) if x < 0.5), key=str)
    assert 0 < after.count() < before.count()


def test_one_of_each_component_stays(stages):
    """Near duplicates of a stage are by five words and a similarity of 0.8, by all pairs."""
    before, after = stages[1]
    assert sorted(r["doc_id"] for r in after.collect()) == brute([(r["doc_id"], r["text"]) for r in before.collect()])


def test_secrets_are_redacted(stages):
    before, after = stages[2]
    old, new = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (before, after))
    rx = re.compile(r"""token = "[0-9a-f]{40}""")
    assert set(old) == set(new)
    for i, t in old.items():
        assert new[i] == rx.sub("<secret>", t)


def test_mix_takes_whole_documents(stages):
    before, after = stages[3]
    sizes, have, most = Counter(), Counter(), Counter()
    for r in before.collect():
        sizes[r["source"]] += len(words(r["text"]))
        most[r["source"]] = max(most[r["source"]], len(words(r["text"])))
    for r in after.collect():
        have[r["source"]] += len(words(r["text"]))
    for s, t in brute_targets(sizes).items():
        assert abs(have[s] - t) <= most[s] / 2 + 1
    assert after.columns == list(corpus_pipeline.COLUMNS)


def test_ids_decode_to_the_texts(stages):
    before, after = stages[4]
    bytes_of = segment.table(segment.vocabulary())
    got = sorted((r["doc_id"], segment.decode(r["ids"], bytes_of)) for r in after.collect())
    assert got == sorted((r["doc_id"], r["text"]) for r in before.collect())


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "token = abcdefghij word", "en", "a", 9), (2, "token = abcdefghij word", "en", "a", 9), (3, "x " * 5000, "en", None, 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as fp", "'k' as key", "2 as score")
    for n, docs in enumerate((odd, odd.limit(0))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{n}-{k}"
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "ids", "n_pieces"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert differences(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name]) == ""


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
