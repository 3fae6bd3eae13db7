"""Hand-worked fixtures for text structure, metadata, ranking, fusion and context."""

import json
import math
import random
import sqlite3
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import GENERIC, LEGAL
from tessera.functions import text as tx
from tessera.operators import bm25, context, enrich, evaluate, fuse, index, rerank, serve, split, vector
from tessera.plans import catalogue, retrieval
from tessera.runtime import scratch
from tessera.sources import legal, store
from tessera.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lits(spark, *values):
    return [F.lit(v).cast("string") if v is None else F.lit(v) for v in values]


# Text


@pytest.mark.parametrize(
    "text,want",
    [("Điều kiện", ["đieu", "kien"]), ("100/2019/NĐ-CP a_b", ["100", "2019", "nđ", "cp", "a", "b"]), ("Ơn ƯỚC", ["on", "uoc"]), ("Straße", ["straße"]), (None, []), ("ét", ["et"])],
)
def test_tokens(spark, text, want):
    assert one(spark, tx.tokens(F.lit(text).cast("string"))) == want


def test_tokens_as_sqlite(spark):
    samples = ["Điều 5. Nghị định số 24/2007/NĐ-CP", "ÀÉÎÕÜ ç ñ ø ł", "l'été x2 _y_", "Ự Ằ ỹ Ơ ư"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='unicode61 remove_diacritics 2')")
    con.execute("create virtual table v using fts5vocab(t, instance)")
    for i, s in enumerate(samples):
        con.execute("insert into t(rowid, x) values (?, ?)", (i, s))
    for i, s in enumerate(samples):
        want = [r[0] for r in con.execute("select term from v where doc = ? order by offset", (i,))]
        assert one(spark, tx.tokens(F.lit(s))) == want


def test_normalize(spark):
    assert one(spark, tx.normalize(F.lit("\r\n a\t  b\r\n\n\n\nc \r"))) == "a b\n\nc"
    assert one(spark, tx.normalize(F.lit("é"), compose=True)) == "é"


def test_small_functions(spark):
    assert one(spark, tx.strip_think(F.lit("<think>a\nb</think> c"))) == "c"
    assert one(spark, tx.flatten_list(F.lit(None).cast("array<string>"))) == ""
    assert one(spark, tx.flatten_list(F.array(F.lit("a"), F.lit("b")))) == "a, b"
    assert one(spark, tx.escape_html(F.lit("<a & b>"))) == "&lt;a &amp; b&gt;"
    assert one(spark, tx.squeeze(F.lit(" a \n b "))) == "a b"
    assert one(spark, tx.content_key(F.lit("  ... "))) is None
    assert one(spark, tx.content_key(F.lit("Điều A-1 é"))) == "điềua1é"
    assert one(spark, tx.asks_year(F.lit("luật 2014"))) and not one(spark, tx.asks_year(F.lit("số 20145")))
    assert [one(spark, tx.expired_flag(F.lit(s).cast("string"), "Hết hiệu lực")) for s in ("Hết hiệu lực: 01/01/2020", "Còn hiệu lực", None)] == [1, 0, 0]
    assert one(spark, tx.without_stop(F.array(F.lit("la"), F.lit("va")), LEGAL.stop)) == ["la", "va"]


# Structure


def test_book_counter(spark):
    rows = [(1, i, n) for i, n in enumerate([1, 2, 3, 1, 2, 5, 3, 2, 1])]
    got = split.books(spark.createDataFrame(rows, "doc_id int, piece int, no long")).orderBy("piece").collect()
    assert [r["book"] for r in got] == [0, 0, 0, 1, 1, 1, 1, 2, 3]


def test_book_counter_as_a_fold(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for d in range(60):
        state, book = -1, 0
        for i in range(rng.randint(1, 15)):
            n = rng.randint(1, 6)
            if state >= 1 and n <= 2 and n < state:
                book += 1
            state = n if n <= 2 else max(state, n)
            rows.append((d, i, n))
            want[d, i] = book
    got = split.books(spark.createDataFrame(rows, "doc_id int, piece int, no long")).collect()
    assert {(r["doc_id"], r["piece"]): r["book"] for r in got} == want


ARTICLES = (
    "CHƯƠNG I QUY ĐỊNH CHUNG\nĐiều 1. Phạm vi điều chỉnh của văn bản mẫu này là toàn bộ nội dung\nĐiều 2. ngắn\n"
    "Điều 3: Theo quy định tại\nĐiều 5 của Luật này thì không có dấu chấm nên không tách đoạn"
)


def test_split_articles(spark):
    docs = spark.createDataFrame([("d", ARTICLES), ("e", None), ("f", "short"), ("g", "no heading but long enough to be kept as a preamble of the document")], "doc_id string, text string")
    got = split.split_documents(docs).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["seq"], r["chapter"], r["article_no"]) for r in got] == [("d#d1", 0, "CHƯƠNG I QUY ĐỊNH CHUNG", "1"), ("d#d3", 1, "CHƯƠNG I QUY ĐỊNH CHUNG", "3"), ("g#pre", 0, "", "")]
    assert "Điều 5 của Luật" in got[1]["text"]
    assert split.split_documents(docs.limit(0)).count() == 0


def test_repeated_article_first_wins(spark):
    body = " nội dung đủ dài để được giữ lại trong kết quả cuối cùng"
    text = f"Điều 3. a{body}\nĐiều 4. b{body}\nĐiều 4. c{body}\nĐiều 5. d{body}"
    got = split.split_documents(spark.createDataFrame([("x", text)], "doc_id string, text string")).orderBy("seq").collect()
    assert [(r["chunk_id"], r["seq"]) for r in got] == [("x#d3", 0), ("x#d4", 1), ("x#d5", 3)]


def test_long_article_parts(spark):
    body = "Điều 7. Tên điều\n" + "\n".join(f"{i}. " + "khoản dài " * 60 for i in range(1, 9))
    got = split.split_documents(spark.createDataFrame([("x", body)], "doc_id string, text string")).orderBy("part").collect()
    assert len(got) > 1 and [r["chunk_id"] for r in got] == [f"x#d7.{r['part']}" for r in got]
    assert all(r["text"].startswith("[tiếp] Điều 7. Tên điều\n") for r in got[1:])
    assert all(r["n_parts"] == len(got) for r in got)


def greedy(text, bounds, limit):
    """Plain form: the farthest boundary within the limit, else a hard cut."""
    out, at = [], 0
    while len(text) - at > limit:
        fit = [b for b in bounds if at < b <= at + limit]
        nxt = max(fit) if fit else at + limit
        out.append(text[at:nxt])
        at = nxt
    return [p for p in (*out, text[at:]) if p.strip()]


@pytest.mark.parametrize("text,want", [("x" * 25, ["x" * 10, "x" * 10, "x" * 5]), ("aaaa\nbbb\nccc\ndd", ["aaaa\nbbb", "\nccc\ndd"])])
def test_greedy_fixture(spark, text, want):
    assert one(spark, split.split_long(F.lit(text), 10, None)) == want


def test_greedy_random(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(1, 90))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", split.split_long(F.col("t"), 12, None).alias("p")).collect():
        t = r["t"]
        want = [t] if len(t) <= 12 else greedy(t, [i for i, c in enumerate(t) if c == "\n" and i], 12)
        assert r["p"] == want
        assert all(len(p) <= 12 for p in r["p"])


def test_truncate_and_label(spark):
    long = "x" * 3000 + "\nPHỤ LỤC 1\n" + "y" * 500
    assert one(spark, F.char_length(split.truncate_tail(F.lit(long)))) == 3001
    assert one(spark, F.char_length(split.truncate_tail(F.lit("a\nPhụ lục\nb")))) == 11
    lab = lambda no, part, n: one(spark, split.label(F.lit(no), F.lit(part), F.lit(n)))
    assert (lab("", 0, 1), lab("5", 0, 1), lab("5", 1, 3)) == ("Phần mở đầu", "Điều 5", "Điều 5 (phần 2/3)")


# Metadata


@pytest.mark.parametrize(
    "raw,preamble,want",
    [
        ("24/2007/ND-CP-HUONG-DAN", "", "24/2007/ND-CP"), ("01/2020/TTLT-BCA-BQP-BTC", None, "01/2020/TTLT-BCA-BQP-BTC"), ("1688/QĐ-TTg", "", "1688/QĐ-TTg"),
        ("61-QĐ/TW", "", "61-QĐ/TW"), (None, "Số: 59/2020/QH14 Hà Nội", "59/2020/QH14"), (None, None, ""), ("abc-def", "", "abc"),
    ],
)
def test_clean_number(spark, raw, preamble, want):
    assert one(spark, enrich.clean_number(*lits(spark, raw, preamble))) == want


@pytest.mark.parametrize("number,date,current,want", [("45/2019/QH14", None, None, 2019), ("1688/QĐ-TTg", "17/06/2020", None, 2020), ("", None, 0, None), ("x", "y", 2014, 2014)])
def test_infer_year(spark, number, date, current, want):
    assert one(spark, enrich.infer_year(*lits(spark, number, date), F.lit(current).cast("int"))) == want


@pytest.mark.parametrize("kind,title,want", [("Luật", "Doanh nghiệp", "Luật doanh nghiệp"), ("Nghị định", "Nghị định về x", "Nghị định về x"), (None, "X y", "X y"), ("Luật", "A", "A"), ("Luật", "", "")])
def test_full_title(spark, kind, title, want):
    assert one(spark, enrich.full_title(*lits(spark, kind, title))) == want


@pytest.mark.parametrize(
    "preamble,want",
    [
        ("QUỐC HỘI\nSố: 59/2020/QH14\nHà Nội, ngày 17 tháng 6 năm 2020\nLUẬT\nDOANH NGHIỆP CỦA VIỆT NAM\nCăn cứ Hiến pháp", "Doanh nghiệp của Việt Nam"),
        ("THÔNG\nTƯ\nHướng dẫn thi hành", "THÔNG TƯ Hướng dẫn thi hành"),
        ("NGHỊ ĐỊNH\nQuy định chi tiết một số điều\nCăn cứ luật", "Quy định chi tiết một số điều"),
        ("x ngày 1 tháng 2 năm 2020\n- Về việc gì đó\nCăn cứ", "Về việc gì đó"),
        ("LUẬT\nngắn", ""), ("", ""), (None, ""), ("Số: 12 văn bản không có dòng loại", ""),
    ],
)
def test_extract_title(spark, preamble, want):
    assert one(spark, enrich.extract_title(F.lit(preamble).cast("string"))) == want


def test_keyed_update_takes_nulls(spark):
    docs = spark.createDataFrame([(1, 2000, "a"), (2, 2001, "b")], "id int, year int, t string")
    new = spark.createDataFrame([(2, None)], "id int, year int")
    assert sorted(map(tuple, enrich.keyed_update(docs, new, "id", ["year"]).collect())) == [(1, 2000, "a"), (2, None, "b")]


# Ranking


ROWS = [("đieu kien x", "foo bar"), ("đieu đieu baz", "foo"), ("alpha beta gamma delta", "q"), ("kien", "w e r t y"), ("mot hai", "ba bon")]


@pytest.mark.parametrize("query,phrase", [("đieu", False), ("kien foo", False), ("đieu kien", True), ("foo bar", True)])
def test_bm25_as_sqlite(spark, query, phrase):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(question, answer)")
    con.executemany("insert into t(rowid, question, answer) values (?, ?, ?)", [(i, *r) for i, r in enumerate(ROWS)])
    match = f'"{query}"' if phrase else " OR ".join(query.split())
    want = dict(con.execute("select rowid, bm25(t, 3.0, 1.0) from t where t match ?", (match,)))
    u = index.units(spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "ref int, question string, answer string"), "ref", ["question", "answer"])
    terms = spark.createDataFrame([(1, t, 1) for t in ([query] if phrase else query.split())], "qid int, tok string, times int")
    got = {r["ref"]: r["score"] for r in bm25.score(index.of(u), terms, LEGAL.qa_weights, pairs=phrase).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12)


def test_bigrams_by_window_and_by_row_agree(spark):
    u = index.units(spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "ref int, question string, answer string"), "ref", ["question", "answer"])
    a, b = (sorted((r["ref"], r["field"], r["tok"]) for r in d.collect()) for d in (index.bigrams(index.postings(u)), index.text_bigrams(u)))
    assert a == b


def test_phrase_choice(spark):
    q = spark.createDataFrame([(1, "a1 b1 c1 d1 e1 f1")], "qid int, text string")
    df = spark.createDataFrame([("a1", 9), ("b1", 1), ("c1", 8), ("e1", 7), ("f1", 6)], "tok string, df long")
    got = bm25.phrases(q, df, LEGAL).orderBy("r").collect()
    assert [r["a"][0] + r["b"][0] for r in got] == ["cd", "de", "ab", "bc"]


def test_doc_boost(spark):
    f = lambda q, kind, year, expired, title: one(spark, bm25.doc_boost(F.lit(q), F.lit(kind).cast("string"), F.lit(year).cast("int"), F.lit(expired).cast("int"), F.lit(title)))
    assert f("luật doanh nghiệp", "Luật", 2020, 0, "x") == pytest.approx(1.30)
    assert f("luật doanh nghiệp 2014", "Luật", 2020, 0, "x") == pytest.approx(1.12)
    assert f("thuế", "Luật", None, 1, "Sửa đổi luật") == pytest.approx(1 - 0.3 - 0.28)
    assert f("sửa đổi thuế", None, 0, None, "Sửa đổi luật") == pytest.approx(1.0)


# Fusion


def test_rrf(spark):
    rows = [(1, 1, 1, "c", "x", "a"), (1, 1, 2, "c", "y", "a"), (1, 2, 1, "c", "y", "b"), (1, 2, 2, "c", "z", "b")]
    got = fuse.rrf(spark.createDataFrame(rows, "qid int, list_no int, pos int, kind string, ref string, source string")).orderBy("new_pos").collect()
    assert [r["ref"] for r in got] == ["y", "x", "z"]
    assert got[0]["score"] == pytest.approx(1 / 62 + 1 / 61) and got[0]["sources"] == ["a", "b"]


HITS = "qid int, pos int, key string, doc_type string, year int, expired int, score double, sources array<string>, ref string"


def with_authority(df):
    return df.withColumn("authority", fuse.authority(F.col("expired"), fuse.type_rank(F.col("doc_type")), F.col("year")))


def test_dedupe(spark):
    rows = [
        (1, 1, "k", "Nghị định", 2010, 0, 0.5, ["bm25"], "h1"), (1, 2, "k", "Luật", 2020, 0, 0.4, ["vector"], "h2"),
        (1, 3, "k", "Thông tư", 2021, 0, 0.3, ["bm25"], "h3"), (1, 4, None, None, None, None, 0.9, ["x"], "h4"), (1, 5, "m", None, None, 0, 0.1, ["b", "a"], "h5"),
    ]
    got = fuse.dedupe(with_authority(spark.createDataFrame(rows, HITS))).orderBy("pos").collect()
    assert [(r["ref"], r["pos"], r["score"], r["sources"]) for r in got] == [("h2", 1, 0.5, ["bm25", "vector"]), ("h5", 2, 0.1, ["b", "a"]), ("h4", 3, 0.9, ["x"])]


def test_dedupe_as_a_loop(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for q in range(40):
        best, order, free = {}, [], []
        for p in range(1, rng.randint(2, 12)):
            key = rng.choice(["a", "b", None])
            rank = (rng.randint(0, 1), rng.randint(0, 2), -rng.randint(2000, 2002))
            h = [f"{q}.{p}", p / 100, sorted(rng.sample(["s", "t", "u"], rng.randint(1, 2)))]
            kind = {0: "Hiến pháp", 1: "Luật", 2: "Pháp lệnh"}[rank[1]]
            rows.append((q, p, key, kind, -rank[2], rank[0], h[1], h[2], h[0]))
            if key is None:
                free.append(h)
            elif key not in best:
                best[key] = (rank, h)
                order.append(key)
            elif rank < best[key][0]:
                old = best[key][1]
                best[key] = (rank, [h[0], old[1], sorted(set(old[2]) | set(h[2]))])
        want[q] = [best[k][1] for k in order] + free
    got = fuse.dedupe(with_authority(spark.createDataFrame(rows, HITS))).collect()
    for q, hits in want.items():
        assert [[r["ref"], r["score"], r["sources"]] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["pos"])] == hits


def test_demote(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.9, "a"), (1, 2, 0, 0.1, "b"), (1, 3, None, 0.1, "c"), (1, 4, 0, 0.5, "d")], "qid int, pos int, expired int, score double, ref string")
    assert [r["ref"] for r in fuse.demote(df).orderBy("pos").collect()] == ["d", "b", "c", "a"]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 1, "t", "alpha"), (1, 2, "t", "beta gamma"), (1, 3, "t", "beta")], "qid int, pos int, title string, text string")
    q = spark.createDataFrame([(1, "beta gamma")], "qid int, text string")
    assert [r["text"] for r in rerank.rerank(hits, q, 3, 2).orderBy("pos").collect()] == ["beta gamma", "beta"]
    assert [r["text"] for r in rerank.rerank(hits, q, 3, 2, enabled=False).orderBy("pos").collect()] == ["alpha", "beta gamma"]


# Context


@pytest.mark.parametrize("sizes,n", [([100, 23950, 10], 1), ([30000], 1), ([30000, 5], 1), ([12000, 12000, 1], 2)])
def test_budget(spark, sizes, n):
    df = spark.createDataFrame([(1, i, "x" * s) for i, s in enumerate(sizes)], "qid int, pos int, block string")
    assert context.pack(df).count() == n


def test_history(spark):
    roles = ["system", "user", "assistant", "user", "system", "assistant"]
    df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], "conv_id int, turn int, role string, text string")
    assert [r["role"] for r in context.history(df).orderBy("turn").collect()] == ["assistant", "user", "assistant"]


def test_prompt_messages_citations(spark):
    past = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))
    got = one(spark, context.messages("sys", past, F.lit("q"), F.lit("[1] src")))
    assert [m["role"] for m in got] == ["system", "user", "user"] and "[1] src" in got[2]["content"]
    assert "NGUỒN" not in one(spark, context.prompt(F.lit("q"), F.lit("")))
    assert one(spark, context.citations(F.lit("a [2] b [12][2] [0] [123] [1]"), F.lit(3))) == [1, 2]


def test_source_blocks(spark):
    no = F.lit(None).cast("string")
    f = lambda kind, **k: one(spark, context.format_source(F.lit(3), F.lit(kind), F.lit("T"), k.get("label", no), F.lit("a\n\n\nb "), k.get("dt", no), k.get("num", no), k.get("ch", no), F.lit(k.get("ex", 0)), no, k.get("area", no)))
    assert f("chunk", dt=F.lit("Luật"), num=F.lit("1/2"), ch=F.lit("Chương I"), ex=1) == "[3] Luật 1/2 — T\n    Chương I\n    ⚠️ [ĐÃ HẾT HIỆU LỰC — không rõ ngày]\na\nb"
    assert f("qa") == "[3] Hỏi đáp pháp luật (chung) — T\na\nb"
    assert f("doc", label=F.lit("Luật"), num=F.lit("9")).startswith("[3] Luật 9 — T\n    (chỉ có")


def test_stream_parsing(spark):
    lines = ['{"message":{"content":"a"}}', "", "broken", '{"message":{"content":"b"},"done":true}', '{"message":{"content":"c"}}']
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    assert [r["content"] for r in context.parse_stream(df).orderBy("n").collect()] == ["a", "b"]


# Evaluation


def test_measures(spark):
    ranks = [1] * 6 + [2] + [None] * 3
    m = evaluate.measure(spark.createDataFrame(list(enumerate(ranks)), "qid int, rank int")).first()
    assert (m["r1"], m["r3"], m["mrr"]) == (pytest.approx(0.6), pytest.approx(0.7), pytest.approx(0.65))
    assert one(spark, evaluate.article_matches(F.lit("Điều 5 (phần 1/2)"), F.lit("5")))


# Vectors


def test_encoder_is_unit_and_stable(spark):
    enc = vector.hashing_encoder(32)
    df = spark.createDataFrame([("a b",), ("a b",), ("",)], "t string").select(enc("t").alias("v"))
    a, b, _ = [r["v"] for r in df.collect()]
    assert a == b and math.isclose(sum(x * x for x in a), 1, rel_tol=1e-6)


def test_embedding_texts(spark):
    assert one(spark, vector.qa_embedding_text(F.lit("q"), F.lit(""), F.lit("ans"))) == "q\nans"
    assert one(spark, vector.term_embedding_text(F.lit("t"), F.lit(None).cast("string"))) == "t: "


# Sources, sinks, streams


def test_upsert_state_pages(spark):
    path = scratch(spark, "state")
    store.set_state(spark, path, "a", "1", 1)
    store.set_state(spark, path, "a", "2", 2)
    store.set_state(spark, path, "b", "3", 3)
    assert (store.get_state(spark, path, "a"), store.get_state(spark, path, "b"), store.get_state(spark, path, "c")) == ("2", "3", None)
    store.reset(spark, path)
    with pytest.raises(FileNotFoundError):
        store.open_table(spark, path, store.STATE)
    df = spark.range(10)
    assert [r["id"] for r in store.keyset_page(df, "id", 4, 3).collect()] == [5, 6, 7]
    assert store.evolve(df, {"x": "int", "id": "long"}).columns == ["id", "x"]


def test_gold_file(spark, tmp_path):
    (tmp_path / "gold.json").write_text('[{"q": "a", "expect_doc": "1/2", "expect_dieu": "5"}]')
    assert [tuple(r) for r in store.read_gold(spark, str(tmp_path / "gold.json")).collect()] == [("a", "1/2", "5")]


def test_legal_corpus_end_to_end(spark, tmp_path):
    schema = "id string, doc_type string, doc_number string, year int, issuer string, tier int, legal_area string, title string, url string, issue_date string, effective_date string, status string, signer string, num_articles int, vn_chars int, vn_text string"
    row = lambda i, tier, status, text: (i, "Luật", "1", 2020, "QH", tier, "", "t", "", "", "", status, "", 1, 1, text)
    raw = spark.createDataFrame([row("a", 0, "Hết hiệu lực: x", ARTICLES), row("b", 2, None, ARTICLES), row("c", None, None, ARTICLES), row("d", 1, None, "")], schema)
    raw.write.parquet(f"{tmp_path}/c/documents-1.parquet")
    docs, chunks = legal.documents(legal.read_documents(spark, f"{tmp_path}/c/documents-1.parquet", "*"))
    assert {r["id"]: (r["expired"], r["has_text"]) for r in docs.collect()} == {"a": (1, 1), "b": (0, 0), "c": (0, 0), "d": (0, 0)}
    assert {r["chunk_id"] for r in chunks.collect()} == {"a#d1", "a#d3"}


def test_ingest_resumes(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    spark.range(5).write.parquet(f"{src}/a")
    df = spark.range(5)
    df.coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(spark, src, df.schema, sink, ck)
    assert ingest.read_once(spark, sink, ["id"]).count() == 5
    spark.range(5, 9).coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(spark, src, df.schema, sink, ck)
    got = ingest.read_once(spark, sink, ["id"])
    assert got.count() == 9 and spark.read.parquet(sink).count() == 9
    files = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r["name"] for r in ingest.unfinished(files, files.filter("name = 'a'")).collect()] == ["b"]


def test_embedding_build_resumes(spark, tmp_path):
    sink, state = str(tmp_path / "vectors"), str(tmp_path / "state")
    rows = spark.range(1, 101).selectExpr("id AS ref", "concat('text ', id) AS text").unionByName(spark.createDataFrame([(None, "no ref")], "ref long, text string"))
    encode = vector.hashing_encoder(8, "passage: ")
    run = lambda r, **more: ingest.embed_new(r, "chunk", encode, sink, state, **more)
    assert run(rows, batch_rows=25, most=1) == (1, 100)
    first = spark.read.parquet(sink).count()
    assert 0 < first < 100
    cursor = store.get_state(spark, state, "embed_cursor_chunk_default")
    assert run(rows)[0] == 1 and run(rows) == (0, 100)
    # An append whose cursor was not saved is made again.
    store.set_state(spark, state, "embed_cursor_chunk_default", cursor, 1000)
    run(rows)
    assert spark.read.parquet(sink).count() == 200 - first
    got = ingest.read_once(spark, sink, ["vid"])
    assert sorted(r["ref"] for r in got.collect()) == list(range(1, 101))
    # Further rows, another model, and a kind without rows.
    assert run(spark.range(1, 121).selectExpr("id AS ref", "'x' AS text")) == (1, 120)
    assert run(rows, model="other") == (1, 100)
    assert ingest.embed_new(rows.filter("ref < 0"), "qa", encode, sink, state) == (0, 0)


def test_windowed_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = ingest.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), late="40 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    a, b = (sorted((str(r["w"]), r["event_type"], r["n"]) for r in d.collect()) for d in (spark.table("hours"), ingest.windowed_counts(events)))
    assert a == b and len(a) > 0


# Serving


def test_requests_and_serialisation(spark):
    serve.check_request("q")
    for bad in ({"question": ""}, {"question": "q", "top_k": 0}, {"question": "q", "limit": 101}, {"question": "q", "q": "x" * 301}):
        with pytest.raises(ValueError):
            serve.check_request(**bad)
    assert one(spark, serve.sse(F.struct(F.lit("token").alias("type")))) == 'data: {"type":"token"}\n\n'
    assert one(spark, serve.display(F.lit(""), F.lit("b"))) == "b"


@given(st.lists(st.integers(0, 5), max_size=8))
@settings(max_examples=50, deadline=None)
def test_plain_greedy_covers(parts):
    text = "\n".join("x" * p for p in parts)
    assert "".join(greedy(text, [i for i, c in enumerate(text) if c == "\n" and i], 4)).replace("\n", "") == text.replace("\n", "")


def test_index_and_cells_are_built(spark):
    u = index.units(spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "ref int, question string, answer string"), "ref", ["question", "answer"])
    path = scratch(spark, "fts")
    for _ in range(2):
        built = index.build(u, path)
        assert built.words.agg(F.sum("n")).first()[0] == index.postings(u).count() and built.lengths.count() == 5


def test_preview_and_answers(spark):
    from tessera.plans import retrieval

    hits = spark.createDataFrame([(1, 1, "term", "9", "T", "a  b\n c", "", 0.5, None, 0)], "qid int, pos int, kind string, ref string, title string, text string, label string, score double, doc_type string, expired int")
    assert [tuple(r) for r in serve.preview(hits).collect()] == [(1, "T", "a b c")]
    q = spark.createDataFrame([(1, "x?"), (2, "y?")], "qid int, text string")
    got = {r["qid"]: (r["n_sources"], r["prompt"]) for r in retrieval.answer(hits, q).collect()}
    assert got[1][0] == 1 and "[1] Thuật ngữ pháp lý: T" in got[1][1] and got[2][0] == 0 and got[2][1].startswith("Câu hỏi: y?")


def test_profiles():
    assert len(LEGAL.stop) == 52 and GENERIC.article is None and LEGAL.rrf_k == 60


# Worked out by hand from the rules


def test_title_goes_on_from_the_first_date(spark):
    pre = "Số: 1/2001/NĐ-CP ngày 1 tháng 2 năm 2001\nQuy định một ngày 3 tháng 4 năm 2003 của bộ về thuế\nCăn cứ x"
    assert one(spark, enrich.extract_title(F.lit(pre))) == "Quy định một ngày 3 tháng 4 năm 2003 của bộ về thuế"
    assert one(spark, enrich.extract_title(F.lit("Một văn bản không ngày\nCăn cứ"))) == "Một văn bản không ngày"


def test_annex_is_cut_by_code_points(spark):
    text = "😀" * 3000 + "\nPHỤ LỤC I\nbiểu mẫu"
    assert one(spark, F.char_length(split.truncate_tail(F.lit(text)))) == 3001
    assert one(spark, F.char_length(split.truncate_tail(F.lit("PHỤ LỤC I\n" + "x" * 5000 + "\nPHỤ LỤC II")))) == 5021


def test_decomposed_articles_are_found(spark):
    body = " nội dung đủ dài để được giữ lại trong kết quả cuối cùng"
    text = unicodedata.normalize("NFD", f"Điều 1. a{body}\nĐiều 2. b{body}")
    got = split.split_documents(spark.createDataFrame([("x", text)], "doc_id string, text string")).orderBy("seq").collect()
    assert [r["chunk_id"] for r in got] == ["x#d1", "x#d2"] and got[0]["text"] == f"Điều 1. a{body}"
    samples = ["A\u030a \u212b", "\u1100\u1161", "\u0344", "plain", "Ệ", "\u2126 \uf900", "…—", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(samples)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", tx.normalize(F.col("t")).alias("n")).collect()}
    assert got == {i: None if x is None else unicodedata.normalize("NFC", x) for i, x in enumerate(samples)}


def test_preamble_before_articles_is_cut_not_stripped(spark):
    article = "Điều 1. nội dung đủ dài để được giữ lại trong kết quả cuối cùng"
    docs = spark.createDataFrame([("a", "x" * 1199 + " y" * 40 + "\n" + article), ("b", "x" * 1199 + " y" * 40)], "doc_id string, text string")
    got = {r["chunk_id"]: r["text"] for r in split.split_documents(docs).collect()}
    assert got["a#pre"] == "x" * 1199 + " " and got["b#pre"] == "x" * 1199


def test_long_lines_take_time_in_proportion(spark):
    def seconds(n):
        df = spark.range(1).select(F.repeat(F.lit("some words in a line\n"), n).alias("t")).cache()
        df.count()
        began = time.perf_counter()
        assert df.select(F.size(split.split_long(F.col("t"), 2400, None)).alias("k")).first()["k"] == -(-(21 * n) // 2394)
        return time.perf_counter() - began

    seconds(2_000)
    assert seconds(64_000) < 6 * seconds(16_000) + 1


def test_streams_end_on_their_own(spark):
    line = lambda c, done: json.dumps({"message": {"content": c}, "done": done})
    rows = [("x", 1, line("a", False)), ("x", 2, line("b", True)), ("x", 3, line("c", False)), ("y", 1, line("d", False)), ("y", 2, "broken"), ("y", 4, line("e", False))]
    got = context.parse_stream(spark.createDataFrame(rows, "stream string, n int, line string")).collect()
    assert sorted((r["stream"], r["content"]) for r in got) == [("x", "a"), ("x", "b"), ("y", "d"), ("y", "e")]


def _hits(spark):
    rows = [(q, p, "chunk", p, f"t{p}", f"text {p} of words", None, None, 0) for q in (1, 2) for p in range(1, 6)]
    return spark.createDataFrame(rows, "qid int, pos int, kind string, ref int, title string, text string, doc_type string, year int, expired int")


def test_scorer_that_fails_leaves_the_order(spark):
    q = spark.createDataFrame([(1, "words"), (2, "")], "qid int, text string")

    def broken(query, text):
        raise OSError("no model here")

    got = rerank.rerank(_hits(spark), q, 5, 3, broken).collect()
    assert sorted((r["qid"], r["pos"], r["ref"]) for r in got) == [(k, p, p) for k in (1, 2) for p in (1, 2, 3)]
    half = lambda query, text: F.when((query == "") & F.contains(text, F.lit("4")), F.lit(None)).otherwise(F.char_length(text) + F.try_element_at(F.split(text, "[a-z ]+"), F.lit(-2)).cast("double") * 0 + F.instr(text, "5"))
    got = rerank.rerank(_hits(spark), q, 5, 3, half).collect()
    assert sorted(r["ref"] for r in got if r["qid"] == 2) == [1, 2, 3] and min((r["pos"], r["ref"]) for r in got if r["qid"] == 1)[1] == 5


def test_scorer_that_fails_on_a_worker_leaves_the_order(spark):
    """A query all of whose pairs are scored is reranked, one with a pair in a failed batch keeps its order."""
    q = spark.createDataFrame([(1, "words"), (2, "trouble")], "qid int, text string")

    def score(queries, texts):
        if "trouble" in queries:
            raise RuntimeError("out of memory")
        return [float("5" in t) for t in texts]

    got = rerank.rerank(_hits(spark), q, 5, 3, rerank.pair_scorer(score, 1)).collect()
    at = {k: [r["ref"] for r in sorted(got, key=lambda r: r["pos"]) if r["qid"] == k] for k in (1, 2)}
    assert at == {1: [5, 1, 2], 2: [1, 2, 3]}


def test_encoder_that_fails_on_a_worker_leaves_questions_out(spark):
    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("cannot encode")
            return [[1.0, float(len(t))] for t in texts]

        return model

    def missing():
        raise FileNotFoundError("no weights")

    q = spark.createDataFrame([(1, "aa"), (2, "bad one"), (3, None), (4, "cccc")], "qid int, text string")
    encoded = q.select("qid", vector.text_encoder(load, 1)(F.col("text")).alias("embedding"))
    assert {r["qid"]: r["embedding"] for r in encoded.collect()} == {1: [1, 2], 2: None, 3: [1, 0], 4: [1, 4]}
    store = spark.createDataFrame([(7, "chunk", 70, [1.0, 2.0]), (8, "chunk", 80, [1.0, 0.0])], "vec_id int, kind string, ref int, embedding array<float>")
    assert sorted((r["qid"], r["ref"]) for r in retrieval.vector_hits(store, encoded, 1).collect()) == [(1, 70), (3, 80), (4, 70)]
    none = q.select("qid", vector.text_encoder(missing)(F.col("text")).alias("embedding"))
    assert retrieval.vector_hits(store, none, 1).count() == 0


def test_source_that_fails_while_it_runs_is_left_out(spark):
    q = spark.createDataFrame([(1, "alpha beta")], "qid long, text string")
    u = index.units(spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "id long, body string"), "id", ["body"])
    late = lambda: spark.createDataFrame([(1, "chunk", 5, 1)], "qid long, kind string, ref long, pos int").filter(F.raise_error(F.lit("lost")).isNull())
    got = retrieval.lists(q, bodies=lambda: index.of(u), vector=late, apart=True).collect()
    assert [(r["kind"], r["ref"], r["pos"]) for r in got] == [("chunk", 1, 1)]


def test_pairs_are_scored_in_batches_of_like_length(spark):
    sizes = []

    def score(q, t):
        assert len(q) <= 4
        return [float(len(a) * 1000 + len(b)) for a, b in zip(q, t, strict=True)]

    df = spark.createDataFrame([("a" * (i % 3), "b" * ((i * 7) % 50) if i else None) for i in range(40)], "q string, t string")
    got = df.select("q", "t", rerank.pair_scorer(score, 4)(F.col("q"), F.col("t")).alias("s")).collect()
    assert all(r["s"] == len(r["q"]) * 1000 + len(r["t"] or "") for r in got) and not sizes


def test_source_that_fails_is_left_out(spark):
    q = spark.createDataFrame([(1, "alpha beta")], "qid long, text string")
    u = index.units(spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "id long, body string"), "id", ["body"])

    def gone():
        raise FileNotFoundError("no such table")

    got = retrieval.lists(q, bodies=lambda: index.of(u), qa=gone, vector=gone).collect()
    assert [(r["kind"], r["ref"], r["pos"]) for r in got] == [("chunk", 1, 1)]
    with pytest.raises(ValueError):
        retrieval.lists(q, qa=gone)


def test_without_reranking_hits_stay_as_they_stand(spark):
    """A whole document has no text; without reranking it keeps the place that its score gives."""
    ranked = spark.createDataFrame([(1, 1, 1, "doc", 7, "bm25"), (1, 2, 1, "doc", 7, "vector"), (1, 2, 2, "chunk", 8, "vector")], "qid long, list_no int, pos int, kind string, ref long, source string")
    payload = spark.createDataFrame([("doc", 7, "T", "", None, None, 0), ("chunk", 8, "U", "some text", None, None, 0)], "kind string, ref long, title string, text string, doc_type string, year int, expired int")
    q = spark.createDataFrame([(1, "some")], "qid long, text string")
    places = lambda rr: [r["kind"] for r in sorted(retrieval.retrieve(ranked, payload, q, 8, rr).collect(), key=lambda r: r["pos"])]
    assert places(False) == ["doc", "chunk"] and places(True) == ["chunk", "doc"]


def test_document_by_its_number(spark):
    rows = [(i, f"Luật số {i}", f"{50 + i}/2020/QH14", "Quốc hội", None, None, "Luật", 2020, 0, 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "id long, title string, doc_number string, issuer string, title_vi string, number_vi string, doc_type string, year int, expired int, tier int")
    ix = index.of(index.units(docs, "id", ["title", "doc_number", "issuer", "title_vi", "number_vi", "doc_type"]))
    q = spark.createDataFrame([(1, "59/2020/QH14"), (2, "")], "qid long, text string")
    got = retrieval.search_docs(ix, docs, q, 3).collect()
    assert [r["ref"] for r in got if r["qid"] == 1 and r["pos"] == 1] == [9] and sorted(r["ref"] for r in got if r["qid"] == 2) == [0, 1, 2]


def test_article_of_the_gold_answer(spark):
    gold = spark.createDataFrame([(1, "59/2020/QH14", "111")], "qid int, ref string, article string")
    hits = spark.createDataFrame([(1, "59/2020/QH14", 1, "Điều 46"), (1, "59/2020/QH14", 2, "Điều 111 (phần 1/2)")], "qid int, ref string, pos int, label string")
    assert evaluate.gold_ranks(gold, hits).first()["rank"] == 2 and evaluate.gold_ranks(gold.drop("article"), hits).first()["rank"] == 1


def test_ablation_tells_seconds(spark):
    gold = spark.createDataFrame([(1, 5), (2, 6)], "qid int, ref int")
    hits = spark.createDataFrame([(1, 5, 1), (2, 6, 2)], "qid int, ref int, pos int")
    got = {r["config"]: r for r in evaluate.ablation(gold, {"a": hits, "b": hits.filter("qid = 1")}).collect()}
    assert got["a"]["mrr"] == 0.75 and got["b"]["mrr"] == 0.5 and got["a"]["seconds"] > 0


def test_swap_that_was_cut_off_is_finished(spark):
    path = scratch(spark, "swap")
    schema = "key string, value string, load_seq long"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.set_state(spark, path, "a", "1", 1)
    fs.rename(fs_path(path), fs_path(f"{path}.old"))
    assert store.get_state(spark, path, "a") == "1"
    spark.createDataFrame([("a", "2", 2)], schema).write.parquet(f"{path}.next")
    fs.rename(fs_path(path), fs_path(f"{path}.old"))
    assert store.get_state(spark, path, "a") == "2"
    store.set_state(spark, path, "a", "3", 3)
    assert store.get_state(spark, path, "a") == "3"
