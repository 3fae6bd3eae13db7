"""Time-ordered target encoding against a plain version."""

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import encoding

FIELDS = "sale_id item_id vendor_id n_lines n_returned item_n item_rate vendor_n vendor_rate client_n client_rate".split()


def plain(lines, sales, items, vendors, clients):
    once = {}
    for sale, client, at in sales:
        if sale is not None and at is not None:
            told = (at, -1 if client is None else client)
            once[sale] = min(once.get(sale, told), told)
    known = []
    for table in (items, vendors, clients):
        seen = {}
        for k, v in table:
            if k is not None:
                seen[k] = v if seen.get(k) is None else seen[k] if v is None else min(seen[k], v)
        known.append(seen)
    rows = []
    for sale, item, vendor, flag in lines:
        if sale in once:
            at, client = once[sale]
            item = -1 if item is None else item
            fold = zlib.crc32(str(sale).encode()) % 5
            values = (None, known[0].get(item), known[1].get(vendor), known[2].get(client), item, vendor, client)
            rows.append(((sale, item, vendor), at, fold, values, flag == "returned"))
    rate = lambda h, p: p if h[0] < 1 else (1000000 * h[1] + 50 * p) // (h[0] + 50)
    out, own = {}, defaultdict(lambda: [0, 0])
    for key, at, fold, values, back in rows:
        own[key][0] += 1
        own[key][1] += back
        past = [r for r in rows if r[2] != fold and r[1] < at]
        h = [(sum(r[3][i] == v for r in past), sum(r[3][i] == v and r[4] for r in past)) for i, v in enumerate(values)]
        root = rate(h[0], 500000)
        out[key] = [x for i in (1, 2, 3) for x in (h[i + 3][0], rate(h[i + 3], rate(h[i], root)))]
    return {(*k, *own[k], *v) for k, v in out.items()}


def told(spark, tables, **options):
    schemas = (
        "sale_id long, item_id long, vendor_id long, flag string", "sale_id long, client_id long, sold_at timestamp_ntz",
        "item_id long, kind string", "vendor_id long, nation_id int", "client_id long, segment string",
    )
    clash = ["'x' AS n", "'y' AS t", "'z' AS chunk", "1 AS edge", "2 AS everything"]
    frames = [spark.createDataFrame(rows, schema).selectExpr("*", *clash) for rows, schema in zip(tables, schemas, strict=True)]
    return {tuple(r[f] for f in FIELDS) for r in encoding.encode(*frames, **options).collect()}


@pytest.mark.parametrize("chunks", [1, 13])
def test_encoding_against_plain(spark, chunks):
    rng = random.Random(chunks)
    start = datetime(2024, 3, 30, 23)
    hot = lambda most: 1 if rng.random() < 0.4 else rng.choice([None, *range(most)])
    sales = [(i, hot(6), None if rng.random() < 0.1 else start + timedelta(microseconds=rng.choice([0, 1, 2, 3, 10**6, 5 * 10**9]) * rng.randint(0, 9))) for i in range(60)]
    sales += [(3, 5, start), (4, None, start), (4, 2, start), (None, 1, start), (77, 1, start)]
    lines = [(rng.choice([None, 7, 7, 7, *range(65)]), hot(9), hot(5), rng.choice([None, "returned", "kept"])) for _ in range(300)]
    items = [(i, rng.choice([None, "a", "b"])) for i in range(7)] + [(1, "c"), (None, "a")]
    vendors = [(i, rng.choice([None, 1, 2])) for i in range(4)]
    clients = [(i, rng.choice([None, "s", "t"])) for i in range(5)]
    tables = (lines, sales, items, vendors, clients)
    assert told(spark, tables, chunks=chunks) == plain(*tables)


def test_encoding_of_no_rows(spark):
    assert told(spark, ([], [], [], [], [])) == set()
    assert told(spark, ([(1, 1, 1, "kept")], [(1, 1, None)], [], [], [])) == set()


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_scan_does_not_depend_on_batches(size):
    rng = random.Random(size)
    rows = sorted((rng.choice([0, 1, 1, 1, 4]), rng.randint(0, 6), rng.randint(0, 4), rng.randint(1, 3)) for _ in range(50))
    scan, got = encoding.Scan(), []
    for i in range(0, len(rows), size):
        v, t, f, n = zip(*rows[i : i + size], strict=True)
        a, b, head = scan.step(pa.array([None if x == 4 else x for x in v], pa.int64()), pa.array(t, pa.timestamp("us")), np.array(f), np.array(n), np.array(n) * 2)
        got += zip(a.tolist(), b.tolist(), head.tolist(), strict=True)
    for (v, t, f, _), (a, b, head) in zip(rows, got, strict=True):
        want = sum(n for w, u, g, n in rows if w == v and u < t and g != f)
        assert (a, b) == (want, 2 * want)
        assert head == (0 if v != rows[0][0] else 1 if t == rows[0][1] else 2)
