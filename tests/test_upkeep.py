"""Tables merged by touched files, and document frequencies of a stateful stream."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index
from tessera.sources.keyed import KeyedTable
from tessera.streaming import frequencies as freq

ROW = "k long, part string, seq long, v string"


def held(t):
    return sorted(tuple(r) for r in t.read().select("k", "seq", "v").collect())


def test_only_touched_files_are_written(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id AS k", "0L AS seq", "concat('v', id) AS v")
    t = KeyedTable(spark, f"{tmp_path}/t", ["k"], ["seq"], file_rows=250)
    assert t.merge(rows) and len(t.state["files"]) == 16
    before = set(t.state["files"])
    changed = spark.createDataFrame([(5, 1, "new"), (6, 1, None), (3999, 1, "new"), (9000, 1, "added")], "k long, seq long, v string")
    holding = {
        "/".join(r[0].split("/")[-2:])
        for r in spark.read.parquet(*[f"{tmp_path}/t/{f}" for f in before]).filter("k in (5, 6, 3999)").select("_metadata.file_path").distinct().collect()
    }
    t.merge(changed)
    assert before - set(t.state["files"]) == holding and len(holding) == 2
    want = {i: (i, 0, f"v{i}") for i in range(4000)} | {5: (5, 1, "new"), 6: (6, 1, None), 3999: (3999, 1, "new"), 9000: (9000, 1, "added")}
    assert held(t) == sorted(want.values()) == held(KeyedTable(spark, f"{tmp_path}/t", ["k"], ["seq"]))


def test_merges_end_as_one_pass_would(spark, tmp_path):
    """Random batches with repeats, ties, late changes, withdrawn and null keys, in two orders, against a plain dictionary."""
    rng = random.Random(3)
    changes = [(rng.choice([None, *range(40)]), rng.choice("ab"), rng.randint(0, 9), rng.choice(["x", "y", None]), rng.random() < 0.3) for _ in range(600)]
    changes += changes[:50] + [(7, "a", rng.randint(0, 9), "hot", False) for _ in range(300)]
    key = lambda x: (x[2], x[3] is not None, x[3] or "", x[4])
    want = {}
    for c in changes:
        if c[0] is not None and ((c[0], c[1]) not in want or key(c) > key(want[c[0], c[1]])):
            want[c[0], c[1]] = c
    want = sorted(c[:4] for c in want.values() if not c[4])
    for n, order in enumerate((changes, changes[::-1])):
        t = KeyedTable(spark, f"{tmp_path}/{n}", ["k", "part"], ["seq"], file_rows=10)
        for b in range(3):
            df = spark.createDataFrame([*order[b::3]], f"{ROW}, gone boolean")
            assert t.merge(df, F.col("gone"), batch=b)
            assert not t.merge(df, F.col("gone"), batch=b)
        assert sorted(tuple(r)[:4] for r in t.read().select("k", "part", "seq", "v").collect()) == want


def test_cut_off_merges(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, f"{tmp_path}/t", ["k"], ["seq"], file_rows=100)
    with pytest.raises(FileNotFoundError):
        t.read()
    first = spark.range(300).selectExpr("id AS k", "0L AS seq", "'a' AS v")
    t.merge(first.limit(0))
    assert held(t) == []
    t.merge(first)
    was, more = held(t), spark.createDataFrame([(1, 1, "b"), (500, 1, "b")], "k long, seq long, v string")
    for step in ("touched", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(KeyedTable, step, lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                KeyedTable(spark, f"{tmp_path}/t", ["k"], ["seq"]).merge(more)
        t = KeyedTable(spark, f"{tmp_path}/t", ["k"], ["seq"], file_rows=100)
        assert held(t) == was
    t.merge(more)
    assert held(t) == sorted([r for r in was if r[0] != 1] + [(1, 1, "b"), (500, 1, "b")])
    other = KeyedTable(spark, f"{tmp_path}/t", ["k"], ["seq"])
    t.merge(more)
    with pytest.raises(RuntimeError):
        other.merge(more)


SCHEMA = "ref long, seq long, gone boolean, text string"


def batch_frequencies(spark, changes):
    """The same by one pass: the newest change of each ref, its tokens counted."""
    newest = {}
    for ref, seq, gone, text in changes:
        if ref is not None and seq is not None and (ref not in newest or seq > newest[ref][0]):
            newest[ref] = (seq, None if gone else text)
    u = spark.createDataFrame([(r, "t", t) for r, (_, t) in newest.items()], "ref long, field string, text string")
    return {(r["tok"], r["df"]) for r in index.frequencies(index.postings(u)).collect()}


def test_stream_equals_batch(spark, tmp_path):
    """Rising batches with late and repeated changes, restarts, a batch that fails once, and runs added up."""
    rng = random.Random(5)
    word = lambda: " ".join(rng.choice("một hai ba bốn năm sáu bảy".split()) for _ in range(rng.randint(0, 6)))
    seqs, changes, source = {}, [], f"{tmp_path}/in"

    def start():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
        return freq.keep(stream, f"{tmp_path}/sink", f"{tmp_path}/state", fanout=2)

    for n in range(5):
        part = []
        for _ in range(30):
            ref = rng.choice([None, *range(12)])
            seqs[ref] = seqs.get(ref, -1) + 1
            part.append((ref, seqs[ref], rng.random() < 0.2, rng.choice([word(), None, ""])))
        late = rng.sample(changes, 10) if changes else []
        changes += part
        rng.shuffle(part)
        spark.createDataFrame(part + late, SCHEMA).coalesce(1).write.mode("append").json(source)
        if n == 2:
            real = freq._name
            freq._name = lambda *a: 1 / 0
            with pytest.raises(Exception, match="division"):
                start()
            freq._name = real
        start()
        assert {(r["tok"], r["df"]) for r in freq.frequencies(spark, f"{tmp_path}/sink").collect()} == batch_frequencies(spark, changes)
    assert len(freq._runs(spark, f"{tmp_path}/sink")) < 5
    assert start() == 0 or freq.frequencies(spark, f"{tmp_path}/sink").count() == len(batch_frequencies(spark, changes))
