"""Toxicity, SimHash, HTML, segmentation: edge cases and brute force."""

import itertools
import math
import re
import time
import tracemalloc
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import components, html, segment, simhash, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return segment.vocabulary()


# Toxicity


def labelled(spark, n=300):
    rows = [(i, ("you are a stupid pathetic idiot " * 3 if i % 4 == 0 else "a calm text about birds and rivers ") + f"number {i}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], "doc_id long, toxic int")


def test_toxicity_learns_and_carries_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame(
        [(1, "you stupid idiot", "x", 9.0), (1, "you stupid idiot", "x", 9.0), (None, "", None, None), (5, None, "y", 1.0), (6, "rivers and birds " * 20000, "z", 0.0)],
        "doc_id long, text string, source string, score double",
    )
    got = toxicity.scored(odd, model).collect()
    assert len(got) == 5 and set(got[0].asDict()) == {"doc_id", "text", "source", "score"}
    by = {(r["doc_id"], r["source"]): r["score"] for r in got}
    assert by[(1, "x")] >= 0.5 > by[(6, "z")]
    assert by[(None, None)] == by[(5, "y")]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scored(odd.limit(0), model).count() == 0


def test_toxicity_without_both_classes_falls_back(spark):
    docs, labels = labelled(spark, 40)
    for none in (labels.limit(0), labels.filter("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) as toxic")):
        model = toxicity.train(docs, none)
        assert model.trees is None
        assert toxicity.scored(docs, model).count() == 40


def test_isotonic_rises_and_averages():
    rng = np.random.default_rng(1)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float)
    x, p = toxicity.isotonic(s, y)
    assert (np.diff(p) > 0).all() and (np.diff(x) > 0).all() and 0 <= p[0] and p[-1] <= 1


def test_isotonic_pools_equal_scores():
    x, p = toxicity.isotonic(np.zeros(4), np.array([0.0, 0.0, 1.0, 1.0]))
    assert x.tolist() == [0.0] and p.tolist() == [0.5]
    rng = np.random.default_rng(2)
    s = rng.integers(0, 12, 400).astype(float)
    y = (rng.random(400) < s / 14).astype(float)
    for _ in range(3):
        order = rng.permutation(400)
        x, p = toxicity.isotonic(s[order], y[order])
        # The least squares among rising functions, by the max-min formula over distinct scores.
        at = np.arange(12)
        n, t = np.array([(s == k).sum() for k in at]), np.array([y[s == k].sum() for k in at])
        want = [max(min(t[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, 12)) for i in range(k + 1)) for k in at]
        assert sorted(set(np.round(want, 9))) == pytest.approx(p.tolist())


def test_trees_against_a_plain_walk():
    """A forest's margin, tree by tree and row by row, and its first split by trying all."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = (x[:, 2] + 0.2 * x[:, 0] > 0.3).astype(float)
    forest = toxicity.Boosted(trees=5, depth=2, bins=400).fit(x, y)
    for row, m in zip(x, forest.margin(x), strict=True):
        f = forest.prior
        for feature, cutoff, leaf in forest.fitted:
            node = 0
            for pick, at in zip(feature, cutoff, strict=True):
                node = 2 * node + int(row[pick[node]] > at[node])
            f += leaf[node]
        assert m == pytest.approx(f)
    p = y.mean()
    gain = {}
    for j in range(4):
        for c in np.unique(x[:, j]):
            left = x[:, j] <= c
            g, h = [(y[k] - p).sum() for k in (left, ~left)], [k.sum() * p * (1 - p) for k in (left, ~left)]
            if min(h) >= 0.3:
                gain[j, c] = sum(a * a / (b + 1) for a, b in zip(g, h, strict=True))
    j, c = max(gain, key=gain.get)
    feature, cutoff, _ = forest.fitted[0]
    assert feature[0][0] == j and gain[j, max(v for k, v in gain if k == j and v <= cutoff[0][0])] == pytest.approx(gain[j, c])


def test_toxicity_held_out(spark):
    got = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(got[i]["predicted"], t) for i, t in labels.items() if got[i]["held_out"]]
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    by = sorted((r["margin"], r["score"]) for r in got.values())
    assert all(a[1] <= b[1] for a, b in zip(by[:-1], by[1:], strict=True))
    assert len(got) == 1000 and sum(p == t for p, t in held) / len(held) > 0.93


# SimHash


def brute_fingerprint(text, n):
    from xxhash import xxh64_intdigest

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    if not w:
        return 0
    g = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aB c\n\té Ü", max_size=60), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_fingerprint_brute(text, n):
    assert simhash.fingerprint(text, n) == brute_fingerprint(text, n)


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(set(fps)), 2):
        if bin(a ^ b).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_find_every_component(spark, limit):
    rng = np.random.default_rng(3)
    fps = {0, 1, (1 << 64) - 1}
    for x in rng.integers(0, 1 << 63, 60).tolist():
        fps.add(x)
        for _ in range(int(rng.integers(0, 6))):
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(classes, limit=limit)).collect()}
    want = brute_components(fps)
    for a, b in itertools.combinations(fps, 2):
        assert (got.get(signed(a), signed(a)) == got.get(signed(b), signed(b))) == (want[a] == want[b])


def test_covering_is_complete():
    rng = np.random.default_rng(5)
    half = rng.integers(0, 1 << 32, 50).astype(np.uint64)
    row, anchor, home = simhash.anchors_of(half)
    assert (np.bitwise_count(anchor ^ half[row]) <= 2).all()
    assert (np.bitwise_count(anchor[home] ^ half[row[home]]) <= 1).all() and home.sum() == 50
    for i, x in enumerate(half.tolist()):
        mine = set(anchor[row == i].tolist())
        for b in range(32):
            _, a, h = simhash.anchors_of(np.array([x ^ (1 << b)], dtype=np.uint64))
            assert a[h][0] in mine


def test_near_duplicates_edges(spark):
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(7, words, 1), (3, words, 1), (3, words, 1), (9, words.upper().lower(), 2), (4, "", 0), (2, None, 0), (None, words, 5), (8, "other text entirely different here", 6), (11, " \t\n", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    ids = {(r["doc_id"], r["component_id"]) for r in got}
    assert {(7, 3), (3, 3), (9, 3), (None, 3), (4, 2), (2, 2), (11, 2), (8, 8)} == ids
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 3, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "same words in here"), (None, "same words in here")], "doc_id long, text string")
    assert simhash.one_of_each(nulls).count() == 1


# HTML

PAGES = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>a<p>b", "a b"),
    ("<html><head><title>T</title><script>var a='<p>x</p>';</script><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>One&nbsp;&eacute; two\n  three.</p><p>x.</p></article><footer>Foot</footer></body></html>", "Head One é two three. x."),
    ("<body><header><h1>Site</h1></header><div id=main-menu><ul><li><a>A</a><li><a>B</a></ul></div><div class='post'><h2>Title</h2><p>A long enough paragraph of text, with words.</p><p>Ok.</p></div><div class='sidebar'>side words here</div><section id='comments'><p>first! what a great and long comment this is</p></section></body>", "Title A long enough paragraph of text, with words. Ok."),
    ("<body><div class=cookie-notice>We use cookies</div><main><p><b>Bold <i>deep</b> text</i> goes on here for long.<br>after</p><form><input><label>Name</label></form><aside>ad</aside></main></body>", "Bold deep text goes on here for long. after"),
    ("<article><header><h1>Own head</h1></header><p>Body of the article in words.</p><div class=ad>Buy!</div><ul><li>one<li>two</ul></article>", "Own head Body of the article in words. one two"),
    ("</div></p><p>stray ends do not matter at all</p></article>", "stray ends do not matter at all"),
    ("<p>1 &lt; 2 &#233; &#x41; &unknown; &copy;</p>", "1 < 2 é A &unknown; ©"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_extract(page, want):
    assert html.extract(page) == want


LONG = "A long paragraph of the article, with more words in it than all the other lines of this page taken together have, and then some."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><div><a>Home</a></div><div><h1>T</h1><p>First.</p><section><p>{LONG}</p></section><p>Last.</p></div></body>", f"T First. {LONG} Last."),
        (f"<body><article><p>{LONG}</p></article><article><p>A second article of fewer words.</p></article></body>", f"{LONG} A second article of fewer words."),
        (f"<article><p>{LONG}</p><p>x</p><p>y</p><p>z</p><ul><li><a>Reference one</a><li><a>Reference two</a></ul></article>", f"{LONG} x y z Reference one Reference two"),
        (f"<body><main><article><p>{LONG}</p></article><div><a>More</a></div></main></body>", LONG),
    ],
)
def test_whole_region_stays(page, want):
    assert html.extract(page) == want


BODY = "<h1>Head</h1><p>One long paragraph of an article with many words in it.</p><p>Second one.</p>"
TOLD = "Head One long paragraph of an article with many words in it. Second one."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='elementor-widget elementor-widget-text-editor'><article>{BODY}</article></div><div class=widget>Side words</div></body>",
        f"<body><div class='elementor-widget elementor-widget-text-editor'>{BODY}</div><div class=sidebar>Side words</div></body>",
        f"<body><div class='content-sidebar-wrap'><article>{BODY}</article><aside>Side</aside></div><footer>Foot</footer></body>",
        f"<body><div id='search-page'><main>{BODY}</main></div></body>",
        f"<body><form id=aspnetForm><nav><a>x</a></nav><div>{BODY}</div></form></body>",
        f"<body><div class=comments>{BODY}</div></body>",
        f"<body><main>{BODY}</main><div class='related-posts'><article><p>Other things to read here.</p></article></div></body>",
        f"<body><article>{BODY}</article><div id=comments><article class=comment><p>{'What a fine comment. ' * 40}</p></article></div></body>",
        f"<body><div class=post>{BODY}</div><div id=comments><p>{'What a fine comment. ' * 40}</p></div></body>",
    ],
)
def test_marks_weigh_and_wrappers_stay(page):
    assert html.extract(page) == TOLD


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<html><head><meta charset=utf-8><title>x</title><body><article>{BODY}</article>", TOLD),
        (f"<head><title>x</title><script>var a = '<p>';</script><div class=menu>m</div><article>{BODY}</article>", TOLD),
        ("<head><meta charset=utf-8>Bare words begin the body.<p>More.", "Bare words begin the body. More."),
        (f"<main><h1>Title here</h1><div class='elementor-widget elementor-widget-text-editor'>{BODY}</div></main>", f"Title here {TOLD}"),
        (f"<main><h1>Title here</h1><div class='content-sidebar-wrap'>{BODY}</div><div class=sidebar>Side</div></main>", f"Title here {TOLD}"),
        (f"<article>{BODY}<p class='related-work'>Others have done this.</p><p class='advert'>Buy!</p></article>", f"{TOLD} Others have done this."),
        (f"<article><div class='comments'>{BODY}</div></article>", TOLD),
        (f"<main><article>{BODY}</article><section class=comments><p>{'What a fine comment. ' * 40}</p></section></main>", TOLD),
        (f"<body><select><option>One<option>Two<article>{BODY}</article></body>", TOLD),
        (f"<body><div><button>Go</div><main>{BODY}</main></body>", TOLD),
    ],
)
def test_omitted_ends_and_marks_inside_the_content(page, want):
    assert html.extract(page) == want


def test_deep_nesting_is_linear():
    for unit in ("<div>some words here ", "<b>some words <p>here ", "<div><span class=ad>"):
        began = time.perf_counter()
        html.extract(unit * 5_000)
        middle = time.perf_counter()
        got = html.extract(unit * 50_000)
        assert time.perf_counter() - middle < 30 * (middle - began) + 1
        assert got.split() == (["some", "words", "here"] * 50_000 if "some" in unit else [])


def test_all_pages_against_their_articles(spark):
    """The text between the article tags, told by regular expressions, is what every page of the table has to give."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html.op3_html(spark, SF).collect()}
    assert len(got) == len(rows)
    block = r"(?i)</?(?:p|h[1-6]|ul|ol|li|br|div|article|section|table|tr|td|th|blockquote|pre|header|figure|figcaption)\b[^>]*>"
    for r in rows:
        inner = re.search(r"(?s)<article\b[^>]*>(.*)</article>", r["html"])[1]
        for gone in (r"(?s)<!--.*?-->", r"(?s)<(script|style|aside|form|nav)\b.*?</\1>", r"(?s)<div class=\"?ad\"?>.*?</div>"):
            inner = re.sub(gone, "", inner)
        want = " ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(block, "\n", inner))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_pages_without_article_tags_against_a_plain_version(spark):
    """The pages of the table with a plain div for their article: the ratio has to find the same text without the tag's help."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    bare = [(r["page_id"], re.sub(r"<article\b[^>]*>", "<div>", r["html"]).replace("</article>", "</div>")) for r in rows]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(bare, "page_id long, html string")).collect()}
    whole = {r["page_id"]: html.extract(r["html"]) for r in rows}
    assert sum(got[k] == whole[k] for k in whole) >= 0.9 * len(whole)
    assert sum(whole[k] in got[k] for k in whole) >= 0.97 * len(whole)


def test_main_text_frame(spark):
    pages = spark.createDataFrame([(i % 4, f"u{i}", p, i) for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")
    got = html.main_text(pages, "page_id", "html", "url").collect()
    assert {r["url"]: r["text"] for r in got} == {f"u{i}": w for i, (_, w) in enumerate(PAGES)}
    assert html.main_text(pages.limit(0)).count() == 0


def test_long_page():
    body = "".join(f"<p>Paragraph {i} with a number of words in it.</p>" for i in range(20000))
    got = html.extract(f"<body><nav><a>x</a></nav><article>{body}</article></body>")
    assert got.startswith("Paragraph 0 ") and got.count("Paragraph") == 20000


@given(st.text(alphabet="<>/ab p='\"&;!-", max_size=80))
@settings(max_examples=200, deadline=None)
def test_extract_never_fails(page):
    assert isinstance(html.extract(page), str)


# Segmentation


@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="ab \n▁﷐\x00", max_size=30)), max_size=6))
@settings(max_examples=120, deadline=None)
def test_round_trip(vocabulary, texts):
    ids, per = segment.encode(texts, np.arange(len(texts)), segment.Lattices(vocabulary))
    bytes_of = segment.table(vocabulary)
    at = np.r_[0, np.cumsum(per)]
    for k, t in enumerate(texts):
        assert segment.decode(ids[at[k] : at[k + 1]].tolist(), bytes_of) == (t or "")


def test_samples_follow_the_lattice(vocabulary):
    """Shares of sampled segmentations against all segmentations of a word, enumerated."""
    weight = {t: math.exp(w) for t, _, w in vocabulary.pieces}
    name = {i: t for t, i, _ in vocabulary.pieces}
    word = "▁there"

    def every(rest):
        if not rest:
            yield (), 1.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in weight:
                for tail, w in every(rest[k:]):
                    yield (rest[:k], *tail), w * weight[rest[:k]]

    truth = dict(every(word))
    total = sum(truth.values())
    n = 40000
    ids, per = segment.encode(["there"] * n, np.arange(n), segment.Lattices(vocabulary))
    seen = {}
    for part in np.split(ids, np.cumsum(per)[:-1]):
        key = tuple(name[i] for i in part.tolist())
        seen[key] = seen.get(key, 0) + 1
    assert len(seen) > 3
    for key, w in truth.items():
        assert abs(seen.get(key, 0) / n - w / total) < 0.01


def test_same_segmentation_in_any_partitioning(spark):
    rows = [(i, f"some words repeated {i} times, and more\nlines ▁ here é") for i in range(60)] + [(None, "x"), (None, "x"), (3, None), (4, ""), (5, "long word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    a = sorted(map(str, segment.encoded(docs.repartition(1)).collect()))
    b = sorted(map(str, segment.encoded(docs.repartition(7)).collect()))
    assert a == b and len(a) == len(rows)
    back = segment.decoded(segment.encoded(docs)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((i or -1, t or "") for i, t in rows)
    assert segment.encoded(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["abc", "thereisaword" * 40, "日本語の文章" * 60, "  " * 300 + "x", "é▁a\u0301" * 90, "q" * 700])
def test_windows_of_a_run_change_nothing(vocabulary, monkeypatch, text):
    texts = [text] * 5 + ["a few words " + text + " and\n" + text]
    whole = segment.encode(texts, np.arange(6), segment.Lattices(vocabulary))
    for window in (7, 64):
        monkeypatch.setattr(segment, "LONG", 2)
        monkeypatch.setattr(segment, "WINDOW", window)
        ids, per = segment.encode(texts, np.arange(6), segment.Lattices(vocabulary))
        assert (per == whole[1]).all() and (ids == whole[0]).all()


def test_unbroken_run_in_bounded_memory(vocabulary):
    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(97, 123, 400_000).tolist())) + "漢字" * 20_000
    lattices = segment.Lattices(vocabulary)
    tracemalloc.start()
    ids, per = segment.encode([text], np.array([1]), lattices)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert segment.decode(ids.tolist(), segment.table(vocabulary)) == text and len(lattices.keys) == 0
    assert peak < 60 << 20


def test_bound_on_lattices_changes_nothing(vocabulary, monkeypatch):
    texts = [f"alpha{i} beta gamma{i * 7}" for i in range(400)]
    whole = segment.encode(texts, np.arange(400), segment.Lattices(vocabulary))[0]
    monkeypatch.setattr(segment, "EDGES", 10)
    monkeypatch.setattr(segment, "SLICE", 7)
    assert (segment.encode(texts, np.arange(400), segment.Lattices(vocabulary))[0] == whole).all()


def test_toxicity_fits_no_more_than_its_bound(spark, monkeypatch):
    """A labelled id of very many rows is one training row, and all of them are scored."""
    seen = []
    fit = toxicity.Boosted.fit
    monkeypatch.setattr(toxicity.Boosted, "fit", lambda self, x, y: seen.append(len(y)) or fit(self, x, y))
    hot = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("you idiot "), F.col("id")).alias("text"))
    rest = spark.range(100, 400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "you stupid idiot").otherwise("fine words here").alias("text"))
    labels = rest.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic")).union(spark.range(1).select(F.lit(3).cast("long"), F.lit(1)))
    docs = hot.union(rest)
    model = toxicity.train(docs, labels, sample_rows=50)
    assert seen and max(seen) <= 50
    assert toxicity.scored(docs, model).count() == docs.count()
