"""Queries over tables as the larger runs have them: folders of many files, and more rows than a switch by size would let pass."""

import pytest
from pyspark.sql import functions as F

from tessera.config import GENERIC
from tessera.llm import audit
from tessera.operators import bm25, evaluate, index, lsi, split, vector
from tessera.plans import catalogue
from tessera.sources import tables
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
TABLES = "documents labels benchmark conversations part embeddings events".split()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The smallest tables as folders of three files each."""
    base = tmp_path_factory.mktemp("folders")
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(f"{base}/{t}.parquet")
    return str(base)


@pytest.mark.parametrize("name", ["streamed_frequencies", "incremental_ingest"])
def test_streams_take_tables_of_many_files(spark, folders, name):
    assert differences(catalogue.queries()[name](spark, folders), connect(folders), catalogue.oracle_sql()[name]) == ""


def test_vector_retrieval_is_exact_over_many_vectors(spark, folders, tmp_path):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{folders}/{t}.parquet") if t != "embeddings" else None
    noise = [(F.rand(seed=i) - 0.5).cast("float") for i in range(8)]
    spark.range(0, 12_000, 1, 2).select(F.col("id").alias("vec_id"), F.array(*noise).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert differences(catalogue.queries()["vector_retrieval"](spark, str(tmp_path)), connect(str(tmp_path)), catalogue.oracle_sql()["vector_retrieval"]) == ""


def test_copies_of_units_and_queries_are_scored_once(spark):
    """Sixty times the units and the queries leave as many postings to score; the ranking is that over all units."""
    texts = ["large ring", "hot ring", "hot bolt", "", None, "ring ring large"]
    rows = [(i, texts[i % 6], ["STEEL", "TIN"][i % 4 // 2]) for i in range(720)]
    u = index.units(spark.createDataFrame(rows, "ref long, term string, definition string"), "ref", ["term", "definition"])
    asked = [(q, t, 1) for q in range(90) for t in (("ring", "tin"), ("hot", "nowhere"), ("bolt", "large", "steel"))[q % 3]]
    terms, weights = spark.createDataFrame(asked, "qid long, tok string, times int"), {"term": 5.0}
    rows_of = lambda df: sorted((r["qid"], r["pos"], r["ref"], round(r["score"], 9)) for r in df.collect())
    assert rows_of(bm25.top_by_class(u, terms, 7, weights)) == rows_of(bm25.rank(bm25.score(index.of(u), terms, weights), 7))
    ix, members = index.of_classes(u, 7)
    few, _ = index.of_classes(u.filter("ref < 12"), 7)
    assert ix.words.count() == few.words.count() and members.count() <= 12 * 7
    assert ix.totals.first()["units"] == 720


def test_an_index_for_questions_holds_their_tokens_alone(spark, tmp_path):
    """What no question asks for is not posted; rankings, lengths and totals are those of the whole index."""
    sf = "/root/testdata/sf0.01"
    u, q = tables.bodies(spark, sf).filter("ref < 300"), tables.questions(spark, sf).limit(5)
    asked = bm25.asked(q, GENERIC)
    whole, part = index.build(u, f"{tmp_path}/whole"), index.build(u, f"{tmp_path}/part", asked)
    got = {r["tok"] for r in part.words.unionByName(part.pairs).select("tok").distinct().collect()}
    assert got and got <= {r["tok"] for r in asked.collect()}
    assert part.pairs.count() * 10 < whole.pairs.count()
    for name in ("lengths", "totals"):
        assert sorted(getattr(part, name).collect()) == sorted(getattr(whole, name).collect())
    ways = [
        lambda ix: bm25.rank(bm25.score(ix, bm25.or_terms(q)), 10),
        lambda ix: bm25.top(ix, bm25.or_terms(q), 10, None, outright=0),
        lambda ix: bm25.cascade(ix, q, 10, None, GENERIC),
    ]
    for way in ways:
        a, b = (sorted((r["qid"], r["pos"], r["ref"], round(r["score"], 9)) for r in way(ix).collect()) for ix in (whole, part))
        assert a == b and a


def test_frequencies_and_lengths_need_no_index(spark, monkeypatch):
    monkeypatch.setattr(index, "lay", lambda *_: 1 / 0)
    for name in ("token_document_frequency", "doc_length_stats"):
        assert differences(catalogue.queries()[name](spark, SF), connect(SF), catalogue.oracle_sql()[name]) == ""
    u = spark.createDataFrame([(1, "a", "x y x"), (1, "b", "y z"), (2, "a", None), (None, "a", "x"), (3, "a", "x")], "ref int, field string, text string")
    assert {(r["tok"], r["df"]) for r in index.unit_frequencies(u).collect()} == {("x", 2), ("y", 1), ("z", 1)}


def test_the_encoder_reads_words_once(spark, monkeypatch):
    """However many passes are made, the same tokens become numbers once; an empty and a null text have none."""
    asked, real = [], lsi.tokens
    monkeypatch.setattr(lsi, "tokens", lambda c: (asked.append(1), real(c))[1])
    texts = spark.createDataFrame([(f"w{i % 7} w{i % 5} W{i % 3}",) for i in range(60)] + [("",), (None,)], "text string").coalesce(1)
    cuts, cut = [], lsi.cut
    monkeypatch.setattr(lsi, "cut", lambda df: (cuts.append(cut(df)), cuts[-1])[1])
    p = lsi.fit(texts, dimensions=3, passes=5, share=1.0)
    assert len(asked) == 1 and cuts[-1].columns == ["word", "weight"] and cuts[-1].count() == 62
    assert sorted(p.place) == [f"w{i}" for i in range(7)] and p.block.shape == (7, 3)
    assert sorted(len(r["word"]) for r in cuts[-1].collect())[:3] == [0, 0, 1]


def test_splitting_normalizes_a_text_once(spark):
    """However many filters and expressions look at a text, each step of its normalization stands in the plan once."""
    docs = spark.createDataFrame([(1, "Mở đầu  " * 20 + "\nĐiều 1. " + "a " * 40)], "doc_id int, text string")
    out = split.split_documents(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\n{3,}") == 1
    assert sorted(r["chunk_id"] for r in out.collect()) == ["1#d1", "1#pre"]


def test_blocks_rank_as_all_matches_do(spark, monkeypatch):
    """Of a query no more than the limit leaves a block, however many units match; ties, field weights, repeated and unknown words included."""
    texts = ["red ring", "ring red ring", "hot bolt", "", None, "red hot ring bolt"]
    rows = [(i, texts[i % 6] if i % 50 else "ring of red gold", ["tin", "red"][i % 4 // 2]) for i in range(900)]
    ix = index.of(index.units(spark.createDataFrame(rows, "ref long, a string, b string"), "ref", ["a", "b"]))
    q = spark.createDataFrame([(1, "red ring"), (2, "hot bolt red"), (3, "nowhere"), (4, "ring nowhere red ring"), (5, ""), (6, "gold")], "qid long, text string")
    monkeypatch.setattr(bm25, "UNITS", 100)
    monkeypatch.setattr(bm25, "LEAST_BLOCKS", 3)
    seen, rank = [], bm25.rank
    monkeypatch.setattr(bm25, "rank", lambda rows, limit, *b: (seen.append(rows.count()), rank(rows, limit, *b))[1])
    rows_of = lambda df: sorted((r["qid"], r["pos"], r["ref"], round(r["score"], 9)) for r in df.collect())
    weights = {"a": 2.0, "b": 0.5}
    both, any_, phrases = bm25.and_terms(q, GENERIC), bm25.or_terms(q), bm25.phrase_terms(q, ix.frequencies, GENERIC)
    for got, want in (
        (bm25.best(ix, both, 7, weights), bm25.score_all(ix, both, weights)),
        (bm25.best(ix, any_, 7, weights), bm25.score(ix, any_, weights)),
        (bm25.best(ix, phrases, 7, weights, pairs=True), bm25.score(ix, phrases, weights, pairs=True)),
    ):
        assert 0 < seen[-1] <= 6 * 7 * 9
        assert rows_of(got) == rows_of(rank(want, 7))


def test_copied_labels_do_not_go_through_the_driver(spark):
    """A file of labels is a few bytes a row, and its rows are copied before they are joined: whatever it looks like, it is not broadcast."""
    plan = audit.masks(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_refs_of_a_source_do_not_go_through_the_driver(spark):
    """A file of following refs is a few bytes a row: hits meet it in partitions, whatever its size looks like."""
    hits = spark.createDataFrame([(1, 1, "term", 5), (1, 2, "chunk", 6), (1, 3, "term", -1)], "qid long, pos int, kind string, ref long")
    known = {"term": spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_partkey").alias("ref")), "chunk": spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("ref"))}
    got = vector.hydrate(hits, known)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["kind"], r["ref"]) for r in got.collect()) == [("chunk", 6), ("term", 5)]


def test_an_ablation_plans_one_configuration_at_a_time(spark):
    """Given as functions, each is asked for its hits when it is worked out: of the plans before it nothing is held."""
    gold = spark.createDataFrame([(1, 5), (2, 6)], "qid int, ref int")
    told = []

    def found(name, rows):
        def hits():
            told.append(name)
            return spark.createDataFrame(rows, "qid int, ref int, pos int").withColumn("x", F.lit(len(told))).drop("x")

        return hits

    real = evaluate.cut
    try:
        evaluate.cut = lambda df: (told.append("cut"), real(df))[1]
        got = {r["config"]: r["mrr"] for r in evaluate.ablation(gold, {"a": found("a", [(1, 5, 1), (2, 6, 2)]), "b": found("b", [(1, 5, 1)])}).collect()}
    finally:
        evaluate.cut = real
    assert told == ["a", "cut", "b", "cut"] and got == {"a": 0.75, "b": 0.5}


def test_relations_of_an_index_need_no_pairs(spark, monkeypatch, tmp_path):
    """They are those of the index that is laid, repeated units, null and empty texts included, and texts are dealt once."""
    rows = [(1, "a", "x y x"), (1, "b", "y z"), (1, "a", "x q"), (2, "a", None), (2, "b", ""), (None, "a", "x"), (3, "a", "x"), (4, None, "x 1")]
    u = spark.createDataFrame(rows, "ref int, field string, text string")
    laid, found = index.build(u, f"{tmp_path}/laid"), index.relations(u)
    for name, df in zip(("words", "frequencies", "lengths"), found, strict=True):
        want = getattr(laid, name).select(*df.columns)
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect())), name
    monkeypatch.setattr(index, "lay", lambda *_: 1 / 0)
    got = catalogue.queries()["index_relations"](spark, SF)
    assert differences(got, connect(SF), catalogue.oracle_sql()["index_relations"]) == ""
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or plan.count("hashpartitioning(ref") == 3


def test_rows_that_leave_blocks_do_not_grow_with_the_blocks(spark, monkeypatch, tmp_path):
    """Twenty blocks rank a query's matches: little more than its limit leaves them, all that tie with the last among it, and postings are dealt once."""
    texts = [(i, "red " + "ring " * (i * 7 % 997 // 4)) for i in range(2000)] + [(2000 + i, "blue ring") for i in range(40)] + [(3000 + i, "gold") for i in range(3000)]
    ix = index.of(index.units(spark.createDataFrame(texts, "ref long, a string"), "ref", ["a"]))
    q = spark.createDataFrame([(1, "red"), (2, "red ring"), (3, "blue"), (4, "ring blue")], "qid long, text string")
    monkeypatch.setattr(bm25, "UNITS", 252)
    monkeypatch.setattr(bm25, "LEAST_BLOCKS", 3)
    seen, rank = [], bm25.rank
    monkeypatch.setattr(bm25, "rank", lambda rows, limit, *b: (seen.append({r["qid"]: r["count"] for r in rows.groupBy("qid").count().collect()}), rank(rows, limit, *b))[1])
    rows_of = lambda df: sorted((r["qid"], r["pos"], r["ref"], round(r["score"], 9)) for r in df.collect())
    for limit in (10, 60):
        for terms, want in ((bm25.or_terms(q), bm25.score), (bm25.and_terms(q, GENERIC), bm25.score_all)):
            got = bm25.best(ix, terms, limit)
            assert rows_of(got) == rows_of(rank(want(ix, terms), limit))
            assert all(seen[-1][k] <= 2 * limit + 10 for k in (1, 2)) and seen[-1][3] <= 40
    built = index.build(index.units(spark.createDataFrame(texts, "ref long, a string"), "ref", ["a"]), f"{tmp_path}/ix")
    assert rows_of(bm25.best(built, bm25.or_terms(q), 10)) == rows_of(rank(bm25.score(built, bm25.or_terms(q)), 10))


def test_an_index_laid_in_passes_is_the_same(spark, monkeypatch, tmp_path):
    """By passes, and with texts dealt instead of what is asked for of them, all relations are those of one pass."""
    rows = [(i % 40, "ab"[i % 2], f"red ring {i % 5} of {i % 3}") for i in range(90)] + [(None, "a", "red"), (7, "a", None)]
    u = spark.createDataFrame(rows, "ref int, field string, text string")
    asked = spark.createDataFrame([("red",), ("red ring",), ("of",), ("nowhere",)], "tok string")
    rows_of = lambda ix: {n: sorted(map(str, getattr(ix, n).collect())) for n in ("words", "pairs", "bounds", "lengths", "frequencies", "totals")}
    for which in (None, asked):
        want = rows_of(index.build(u, f"{tmp_path}/one-{which is None}", which))
        laid, lay = [], index.lay
        with monkeypatch.context() as m:
            m.setattr(index, "PASS", 30)
            m.setattr(index, "MANY", 2)
            m.setattr(index, "lay", lambda path, *parts: (laid.append(len(parts)), lay(path, *parts))[1])
            assert rows_of(index.build(u, f"{tmp_path}/many-{which is None}", which)) == want and laid == [4]


def test_texts_of_documents_do_not_travel_unasked(spark):
    """Titles are cut out before labels are joined: the join takes no text where none is asked for."""
    plan = tables.docs(spark, SF).select("id", "title", "expired")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join ", 1)
    assert " AS title#" in below and "text#" not in above
