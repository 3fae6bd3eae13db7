"""Filter interaction audit against a plain version, with nulls, repeats and empty tables."""

import random
import re
from collections import Counter
from itertools import permutations

from tessera.llm import audit

GAP = re.compile("[\x20\x09-\x0d]+")


def plain(docs, labels):
    """{(part, order, step): counts} by walking every order of every document."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, text, part in docs:
        t = text or ""
        w = [x for x in GAP.split(t) if x]
        fails = ""
        fails += "A" * (len(w) < 200)
        fails += "B" * (100 * len(set(w)) < 50 * len(w))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t))
        fails += "D" * any(c in "#$%&*|" for c in t)
        fails += "E" * any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((part or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            before = []
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                shapley[part, f] += len(gone)
                left = [r for r in left if f not in r[1]]
                unique = sum(r[0] == part and r[1] == f for r in rows)
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in before), unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                before += gone
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_audit_against_plain(spark):
    rng = random.Random(3)
    texts = [None, "", " \t", "x " * 250, "A B", "é" * 40 + "A", "a b", "#", "short and clean", " ".join(map(str, range(220))), " ".join(map(str, range(220))) + " $", "Y" * 70000]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(150)]
    docs += [(5, "same", "en")] * 3 + [(4, "same", "fr"), (None, "same", "en"), (9, "same", "en"), (9, "same", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "2 AS n", "3 AS good", "4 AS salt", "5 AS id")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS id", "'y' AS salt")
    assert told(audit.audit(d, y)) == plain(docs, labels)


def test_audit_of_no_rows(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(d, y).count() == 0
    one = audit.audit(spark.createDataFrame([(1, "a", None)], d.schema), y)
    assert one.count() == 600 and {r["part"] for r in one.collect()} == {""}


def test_parts_beyond_what_a_task_holds(spark):
    docs = [(i, "a b c", f"p{i % 700}") for i in range(1400)]
    got = audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.count() == 700 * 600
    assert got.filter("filter_order = 'EABCD' AND step = 1").selectExpr("sum(removed)").first()[0] == 1399


def test_table_of_first_failures():
    table = audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all()
    for k, order in enumerate(audit.ORDERS):
        for mask in range(32):
            failing = [step for step, f in enumerate(order) if mask >> audit.FILTERS.index(f) & 1]
            assert table[mask, k] == (failing[0] if failing else 5)
