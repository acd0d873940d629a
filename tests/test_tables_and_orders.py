"""Printed tables, rate lines, merges, anchored windows, rank agreement."""

from __future__ import annotations

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from dossier.operators import item_tables as it
from dossier.operators import sequences as sq

CELLS = "document_id int, table_no int, row_index int, column_index int, content string"


def grid(spark, *tables):
    return spark.createDataFrame([(d, t, i, j, c) for d, t, rows in tables for i, row in enumerate(rows) for j, c in enumerate(row)], CELLS)


def test_multi_column_tables(spark):
    good = [["Invoice", "7"], ["Item", "Price", "VAT 5%", "VAT Amount", "Net Price", "Total Price"], ["A", "D.OO", "5%", "1", "131,900,00", "2"], ["B", "x", "", "", "", "7"], ["Notes", "", "", "", "", ""], ["Total", "1", "", "", "1", "1"], ["C", "1", "1", "1", "1", "1"]]
    short = [good[1], good[2], good[5]]
    found = it.parse_multi_column_table(grid(spark, (1, 1, short), (1, 2, good), (2, 1, short), (3, 1, [[None, "a"]]))).orderBy("row_index").collect()
    assert [(r["document_id"], r["table_no"], r["description"], r["line_total"]) for r in found] == [(1, 2, "A", 131900.0), (1, 2, "B", 7.0)]
    assert found[0]["columns"] == {"price": 0.0, "vat": 1.0, "net": 131900.0, "total": 2.0} and found[1]["columns"] == {"total": 7.0}


def test_single_row_and_stacked_tables(spark):
    one = [["Tuition", "Books", "VAT 5%", "", "Grand Total", "Sub-Total", "Total"], ["AED 1,000.50", "20", "1", "9", "x", "3", "7 AED"]]
    found = {r["kind"]: r for r in it.parse_single_row_table(grid(spark, (1, 1, one), (2, 1, [*one, ["1"]]), (3, 1, [["A", "Total"], ["1", "2"]]))).filter("kind <> 'item'").collect()}
    assert {k: (r["document_id"], r["amount"]) for k, r in found.items()} == {"tax_amount": (1, 1.0), "total": (1, 7.0), "subtotal": (1, 3.0)} and found["tax_amount"]["rate"] == 5.0
    stacked = [["Particulars", "Qty", "Amount"], ["Term 1\nTerm 2", "1", "AED 100 200.50"], ["Bus", "", "7"], ["Total", "", "307.50"], ["After", "", "1"]]
    spoiled = [stacked[0], stacked[1], ["Bus", "", "free"]]
    rows = it.parse_stacked_table(grid(spark, (1, 1, stacked), (2, 1, spoiled), (3, 1, [stacked[0], ["A\nB", "", "1"]]), (4, 1, [stacked[0], ["A", "", "1"], ["B", "", "2"]]))).orderBy("item_no").collect()
    assert [(r["document_id"], r["description"], r["line_total"], r["total"]) for r in rows] == [(1, "Term 1", 100.0, 307.5), (1, "Term 2", 200.5, 307.5), (1, "Bus", 7.0, 307.5)]


def test_rate_lines(spark):
    text = "2. FEE FOR TERM 1 NUMBER OF DAYS 5\nfirst\n100 PER DAY X 5 DAYS = 500 PAID\n50.5 AED PER WEEK × 2 = 101\n3) Books:\na\nb\nc\nd\n1 PER BOOK * 2 = 2 DUE PAID"
    rows = it.parse_rate_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "document_id int, text string")).orderBy("line_no").collect()
    assert [(r["description"], r["unit_price"], r["unit"], r["quantity"], r["line_total"], r["status"]) for r in rows] == [
        ("FEE FOR TERM 1", 100.0, "DAY", 5.0, 500.0, "paid"), ("50.5 AED PER WEEK × 2 = 101", 50.5, "WEEK", 2.0, 101.0, None), ("1 PER BOOK * 2 = 2", 1.0, "BOOK", 2.0, 2.0, "due"),
    ]


def test_merge_is_a_multiset_join_and_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "llm", "a", 5.0, 11), (1, 2, "llm", "b", 5.0, 12), (1, 3, "llm", "c", None, 13), (1, 4, "llm", "d", 9.0, 14)], "document_id int, place int, source string, description string, line_total double, box int")
    new = spark.createDataFrame([(1, 1, "table", "x", 5.0), (1, 2, "table", "y", 5.001), (1, 3, "table", "z", 5.0), (1, 4, "table", "x", 5.0), (2, 1, "table", "n", 1.0)], "document_id int, place int, source string, description string, line_total double")
    once = it.merge_line_items(old, new)
    rows = [tuple(r) for r in once.orderBy("document_id", "place").collect()]
    assert rows == [(1, 1, "table", "x", 5.0, 11), (1, 2, "table", "y", 5.001, 12), (1, 3, "llm", "c", None, 13), (1, 4, "llm", "d", 9.0, 14), (1, 5, "table", "z", 5.0, None), (2, 1, "table", "n", 1.0, None)]
    again = it.merge_line_items(once, new)
    assert [tuple(r) for r in again.orderBy("document_id", "place").collect()] == rows


def test_reads_in_anchored_windows(spark):
    rng = random.Random(4)
    base = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(600):  # one admin has most of the reads; ties, nulls, and gaps of many windows
        admin = rng.choice([1, 1, 1, None, 2])
        at = base + datetime.timedelta(seconds=rng.choice([rng.randint(0, 3000), 10 * rng.randint(0, 40), rng.randint(0, 10**6)]))
        rows.append((i, admin, 7, rng.choice("pq"), rng.choice(["GET", "GET", "GET", "POST"]), at if i % 50 else None))
    df = spark.createDataFrame(rows, "event_id int, user_id int, company_id int, path string, method string, ts timestamp")
    for window in (0, 10, 600):
        kept, last = [], {}
        for _, u, _c, p, m, t in sorted((r for r in rows if r[5]), key=lambda r: r[5]):
            if m != "GET" or window == 0:
                kept.append((u, p, m, t))
            elif (u, p) not in last or (t - last[u, p]).total_seconds() > window:
                last[u, p] = t
                kept.append((u, p, m, t))
        got = [(r["user_id"], r["path"], r["method"], r["ts"]) for r in sq.access_dedup(df, window).collect()]
        assert sorted(got, key=repr) == sorted(kept, key=repr)
    assert sq.access_dedup(df.limit(0), 10).count() == 0


def test_order_agreement(spark):
    rng = random.Random(5)
    for n, block in ((0, 8), (1, 8), (2, 8), (300, 16), (300, 1000)):
        rows = [(i, rng.random()) for i in range(n)]
        by_b = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: r[1]))}
        discordant = sum(by_b[i] > by_b[j] for i in range(n) for j in range(i + 1, n))
        r = sq.order_agreement(spark.createDataFrame(rows, "i int, v double"), [F.col("i")], [F.col("v")], block).first()
        pairs = n * (n - 1) // 2
        assert (r["n"], r["discordant"]) == (n, discordant) and abs(r["tau"] - (1.0 if not pairs else (pairs - 2 * discordant) / pairs)) < 6e-4
    for _ in range(50):
        v = np.array([rng.randint(0, 50) for _ in range(rng.randint(0, 200))])
        assert sq.inversions(v) == sum(v[i] > v[j] for i in range(len(v)) for j in range(i + 1, len(v)))
