"""An index kept up in segments against full rebuilds."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, index
from tessera.operators.segments import SegmentedIndex
from tessera.runtime import scratch
from tessera.streaming.ingest import index_new

UNIT = "ref int, field string, text string"


def units(spark, texts):
    return spark.createDataFrame([(r, f, t) for r, t in texts.items() for f, t in (("body", t), ("heading", (t or "")[:9]))], UNIT)


def text(rng):
    return " ".join(f"w{int(60 * rng.random() ** 2)}" for _ in range(rng.choice([0, 3, 30]))) or rng.choice([None, ""])


def ranks(ix, terms, **more):
    return sorted((r["qid"], r["pos"], r["ref"], round(r["score"], 9)) for r in bm25.top(ix, terms, 10, {"heading": 2.0}, **more).collect())


def size(spark, path):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(there).getLength()


def test_upserts_and_merges_equal_a_rebuild(spark):
    rng = random.Random(4)
    terms = spark.createDataFrame([(q, f"w{rng.randint(0, 59)}", 1) for q in range(8) for _ in range(5)], "qid int, tok string, times int").dropDuplicates(["qid", "tok"])
    path, live, levels = scratch(spark, "segments"), {}, set()
    for step in range(5):
        batch = {rng.randint(0, 80): text(rng) for _ in range(40 if step == 0 else 9)}
        gone = [] if step == 0 else rng.sample(sorted(live), 3) + [999]
        kept = SegmentedIndex(spark, path, fanout=2)
        assert kept.upsert(units(spark, batch), spark.createDataFrame([(r,) for r in gone if r not in batch], "ref int"))
        live = {r: t for r, t in (live | batch).items() if r not in gone or r in batch}
        levels |= {s["level"] for s in kept.state["segments"]}
    view, whole = SegmentedIndex(spark, path).view(), index.of(units(spark, live))
    for name, cols in (("words", ["tok", "ref", "field", "n", "len", "block"]), ("pairs", ["tok", "ref", "field", "n"]), ("lengths", ["ref", "len"]), ("frequencies", ["tok", "df"]), ("totals", ["units", "avgdl"])):
        a, b = (sorted(map(tuple, getattr(x, name).select(*cols).collect())) for x in (view, whole))
        assert a == b, name
    assert ranks(view, terms) == ranks(whole, terms) == ranks(view, terms, outright=0)
    assert max(levels) >= 2 and len(kept.state["segments"]) < 4
    # The folders are those of the segments and marks that count, and of the version before.
    fs, there = kept._fs()
    names = {f.getPath().getName() for f in fs.listStatus(there(path))}
    counted = {s["name"] for s in kept.state["segments"]} | {f"{k}-{n}" for n in kept.state["dead"] for k in ("dead", "less")} | set(kept.state["replaced"])
    assert {n for n in names if not n.startswith("manifest")} <= counted


def test_what_an_upsert_writes_is_in_proportion(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").cast("int").alias("ref"), F.lit("body").alias("field"), "text")
    path = scratch(spark, "segments")
    kept = SegmentedIndex(spark, path)
    kept.upsert(d)
    before = size(spark, path)
    kept.upsert(d.filter("ref % 100 = 1").withColumn("text", F.concat("text", F.lit(" anew"))))
    assert 0 < size(spark, path) - before < 0.06 * before
    assert kept.view().frequencies.filter("tok = 'anew'").first()["df"] == d.filter("ref % 100 = 1").count()


def test_batches_count_once_and_cut_off_upserts_do_not_count(spark, monkeypatch):
    path = scratch(spark, "segments")
    SegmentedIndex(spark, path).upsert(units(spark, {1: "a b", 2: "b c"}), batch=0)
    assert not SegmentedIndex(spark, path).upsert(units(spark, {1: "z"}), batch=0)
    cut = SegmentedIndex(spark, path)
    monkeypatch.setattr(cut, "_commit", lambda _: (_ for _ in ()).throw(OSError("cut off")))
    with pytest.raises(OSError):
        cut.upsert(units(spark, {1: "z z"}), batch=1)
    view = SegmentedIndex(spark, path).view()
    assert {r["tok"]: r["df"] for r in view.frequencies.collect()} == {"a": 1, "b": 2, "c": 1}
    assert SegmentedIndex(spark, path).upsert(units(spark, {1: "z z"}), batch=1)
    view = SegmentedIndex(spark, path).view()
    assert {r["tok"]: r["df"] for r in view.frequencies.collect()} == {"z": 1, "b": 1, "c": 1} and view.totals.first()["units"] == 2
    SegmentedIndex(spark, path).upsert(None, spark.createDataFrame([(1,), (2,), (3,)], "ref int"))
    assert SegmentedIndex(spark, path).view().lengths.count() == 0
    with pytest.raises(ValueError):
        SegmentedIndex(spark, scratch(spark, "segments")).view()


def test_a_stream_of_files_feeds_the_index(spark, tmp_path):
    source, path, checkpoint = str(tmp_path / "in"), scratch(spark, "segments"), str(tmp_path / "checkpoint")
    take = lambda: index_new(spark, source, units(spark, {}).schema, lambda d: d, path, checkpoint)
    units(spark, {1: "a b", 2: "c"}).coalesce(1).write.mode("append").parquet(source)
    take()
    units(spark, {2: "a", 3: "d"}).coalesce(1).write.mode("append").parquet(source)
    take(), take()
    assert {r["tok"]: r["df"] for r in SegmentedIndex(spark, path).view().frequencies.collect()} == {"a": 2, "b": 1, "d": 1}


def test_a_kept_index_for_standing_questions(spark, tmp_path):
    """Only asked tokens are posted, through upserts, withdrawals and a merge; rankings, lengths and totals are those of the whole index."""
    texts = ["red ring", "hot bolt ring", "cold tin", "", "ring red ring gold"]
    q = spark.createDataFrame([(1, "red ring"), (2, "gold bolt")], "qid long, text string")
    rows = lambda ids, shift=0: index.units(spark.createDataFrame([(i, texts[(i + shift) % 5]) for i in ids], "ref long, a string"), "ref", ["a"])
    views = []
    for name, asked in (("whole", None), ("part", bm25.asked(q))):
        kept = SegmentedIndex(spark, f"{tmp_path}/{name}", fanout=2, asked=asked)
        kept.upsert(rows(range(40)))
        kept.upsert(rows(range(30, 45), 1), spark.createDataFrame([(3,), (4,)], "ref long"))
        views.append(kept.view())
    whole, part = views
    assert {r["tok"] for r in part.words.select("tok").distinct().collect()} == {"red", "ring", "gold", "bolt"}
    assert sorted(part.lengths.collect()) == sorted(whole.lengths.collect()) and part.totals.collect() == whole.totals.collect()
    got = [sorted((r["qid"], r["pos"], r["ref"], round(r["score"], 9)) for r in bm25.top(v, bm25.or_terms(q), 10).collect()) for v in views]
    assert got[0] == got[1] and len(got[0]) == 20
