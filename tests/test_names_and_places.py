"""Fuzzy scores, issuers, places on pages, regions, identity classes."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dossier.functions import fuzzy
from dossier.functions import text as fn
from dossier.operators import contradictions, issuers, operations, placement, regions, validation


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain_ratio(a, b):
    return 200.0 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def some_text(rng):
    return " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 4)))


def test_scores_against_plain_loops():
    rng = random.Random(1)
    for _ in range(600):
        a, b = some_text(rng), some_text(rng)
        assert fuzzy.common_length(a, b) == plain_lcs(a, b)
        assert fuzzy.ratio(a, b) == pytest.approx(plain_ratio(a, b))
        if a and b:
            short, long = sorted((a, b), key=len)
            best = max(plain_ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))
            if len(a) == len(b):
                best = max(best, *(plain_ratio(long, short[max(0, i) : i + len(long)]) for i in range(1 - len(long), len(short))))
            assert fuzzy.partial_ratio(a, b) == pytest.approx(best)
        assert fuzzy.weighted_ratio(a, b) <= fuzzy.most_weighted(a, b, Counter(a), Counter(b)) + 1e-9


def test_golden_scores():
    """Values of the published formulas."""
    p = fuzzy.processed
    assert fuzzy.ratio("this is a test", "this is a test!") == pytest.approx(96.5517241)
    assert fuzzy.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert fuzzy.weighted_ratio("this is a test", "this is a new test!!!") == pytest.approx(85.5)
    assert p("  TechSource Solutions, INC. ") == "techsource solutions  inc"
    assert fuzzy.weighted_ratio(p("TECHSOURCE SOLUTIONS INC."), p("TechSource Solutions Inc.")) == 100
    assert fuzzy.weighted_ratio("", "x") == 0 and fuzzy.token_set_ratio("", "x") == 0 and fuzzy.partial_ratio("", "") == 100


def test_best_matches_in_blocks_are_those_of_every_pair(spark):
    rng = random.Random(2)
    names = [(c, some_text(rng) or "x") for c in range(3) for _ in range(30)]
    named = [(c % 4, some_text(rng)) for c in range(200)] + [(0, None), (0, " "), (0, names[0][1])]
    df = spark.createDataFrame(named, "company_id int, issuer string")
    found = issuers.best_matches(df, spark.createDataFrame(sorted(set(names)), "company_id int, candidate string"), names_at_once=7).collect()
    assert len(found) == len({(c, n) for c, n in named if n and n.strip()})
    for r in found:
        p = fuzzy.processed(r["issuer"])
        scores = [(-round(fuzzy.weighted_ratio(p, fuzzy.processed(n)), 7), n) for c, n in set(names) if c == r["company_id"]]
        assert (r["score"] is None) == (not scores)
        if scores:
            assert r["score"] == pytest.approx(-min(scores)[0]) and r["best_name"] == min(scores)[1]


def test_issuer_variants_and_country(spark):
    rows = spark.createDataFrame([("BRIGHT ACADEMYO®", "AE07 0331", "GBP"), ("شركة الأفق Al Ufuq Co.", "x", "inr"), ("Plain", None, "XYZ")], "n string, i string, c string")
    got = rows.select(issuers.issuer_variants(F.col("n")).alias("v"), issuers.document_country(F.col("i"), F.col("c")).alias("k")).collect()
    assert [r["k"] for r in got] == ["AE", "IN", None]
    assert got[0]["v"] == ["BRIGHT ACADEMYO®", "BRIGHT ACADEMY"] and got[2]["v"] == ["Plain"]
    assert got[1]["v"] == ["شركة الأفق Al Ufuq Co.", "شركة الأفق", "Al Ufuq Co."]


def test_stamps(spark):
    documents = spark.createDataFrame([(1, "Bright Future Academy LLC"), (2, "Other House"), (3, None), (4, "دار النشر"), (5, "No Stamp")], "document_id int, issuer string")
    stamps = spark.createDataFrame([(1, "BRIGHT FUTURE ACADEMY P.O. Box 12 Dubai"), (1, "x"), (2, "Bright Future"), (3, "Bright"), (4, "Latin only"), (5, " "), (1, None)], "document_id int, text string")
    got = {r["document_id"]: (r["status"], r["score"]) for r in issuers.stamp_issuer(stamps, documents).collect()}
    assert got[1] == ("pass", 100.0) and got[2][0] == "flag" and {got[i][0] for i in (3, 4, 5)} == {"skipped"}


def words_of(spark, lines, document=1, page=1):
    rows, n = [], 0
    for y, line in enumerate(lines):
        for x, w in enumerate(line.split()):
            rows.append((document, page, n, w, x * 0.1, y * 0.05, 0.08, 0.02))
            n += 1
    return spark.createDataFrame(rows, "document_id int, page int, word_no int, text string, x double, y double, width double, height double")


def test_locate_fields(spark):
    lines = ["Invoice No INV-7 Date 2024-05-03", "Acme Trading", "Subtotal 100.00", "VAT 0.00", "Grand Total AED 100.00", "Pay Acme Tra ding (Acme-Trading) now", "a rather long remark printed here"]
    words = words_of(spark, lines)
    none = None
    fields = [(1, "amount", [], 100.0, "AED"), (1, "subtotal", [], 100.0, none), (1, "tax_amount", [], 0.0, none), (1, "date", ["3 May 2024", "2024-05-03"], none, none), (1, "issuer", ["Acme Trading"], none, none),
              (1, "note", ["a rather lonq remark printed hore"], none, none), (1, "gone", ["nowhere at all"], none, none), (2, "issuer", ["Acme"], none, none)]
    f = spark.createDataFrame(fields, "document_id int, field string, targets array<string>, number double, currency string")
    printed = words.groupBy("document_id", "page", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ").alias("text"), F.min("x").alias("x"), F.max("width").alias("width"), F.max("height").alias("height"))
    got = {r["field"]: r for r in placement.locate_fields(words, f, printed.withColumn("line_no", (F.col("y") * 20).cast("int"))).collect()}
    row = lambda name: round(got[name]["y"] / 0.05)
    assert (row("amount"), row("subtotal"), row("tax_amount"), row("date"), row("issuer"), row("note")) == (4, 2, 3, 0, 1, 6)
    assert got["amount"]["x"] == pytest.approx(0.2) and got["amount"]["width"] == pytest.approx(0.18)  # the code beside it
    assert set(got) == {"amount", "subtotal", "tax_amount", "date", "issuer", "note"}
    assert placement.locate_fields(words, f.limit(0)).count() == 0


def test_places_are_taken_once(spark):
    """Two fields of one value share its two places; a third takes its best again."""
    words = words_of(spark, ["x 5.00", "y 5.00"])
    f = spark.createDataFrame([(1, n, [], 5.0, None) for n in ("amount", "subtotal", "other")], "document_id int, field string, targets array<string>, number double, currency string")
    got = {r["field"]: round(r["y"], 2) for r in placement.locate_fields(words, f).collect()}
    assert {got["amount"], got["subtotal"]} == {0.0, 0.05} and got["other"] in (0.0, 0.05)


def test_overlaps_against_every_pair(spark):
    rng = random.Random(3)

    def boxes(n):
        return [(rng.randint(1, 2), i, (rng.uniform(-0.1, 1), rng.uniform(0, 1), rng.choice([0.0, 0.05, 0.4, 1.2]), rng.uniform(0, 0.5))) for i in range(n)]

    one, other = boxes(60), boxes(60)
    box = "struct<x:double,y:double,width:double,height:double>"
    left, right = spark.createDataFrame(one, f"page int, i int, a {box}"), spark.createDataFrame(other, f"page int, j int, b {box}")
    got = [(r["i"], r["j"]) for r in regions.overlapping(left, right, ["page"], "a", "b", F.lit(True)).collect()]

    def meet(a, b):
        return all(min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) > 0 for k in (0, 1))

    assert sorted(got) == sorted((i, j) for p, i, a in one for q, j, b in other if p == q and meet(a, b))


def test_identity_contradictions(spark):
    rows = [
        (1, 10, "pan", "full_name", "Mohd Khan", None, False), (1, 11, "pan", "full_name", "Mohammad Khan", None, False), (1, 12, "x", "full_name", "Mohammad Khan", None, False), (1, 13, "x", "full_name", "Ravi Sen", None, True),
        (1, 10, "pan", "id_number", "1234-5678", None, False), (1, 11, "pan", "id_number", "XXXX5678", None, False), (1, 12, "pan", "id_number", "12345679", None, False), (1, 13, "x", "id_number", "999", None, False),
        (1, 10, "pan", "annual_income", "100", "INR", False), (1, 11, "pan", "annual_income", "200", "INR", False), (1, 12, "pan", "annual_income", "900", "USD", False), (1, 13, "x", "gender", "", None, False), (1, 12, "x", "gender", None, None, None),
        (1, 10, "pan", "address", "12 MG Rd 400001", None, False), (1, 11, "pan", "address", "12 Mahatma Gandhi Road 400001", None, False),
    ]
    df = spark.createDataFrame(rows + rows[:3], "case_id int, document_id int, document_type string, field string, value string, currency string, uncertain boolean")
    got = {(r["field"], r["value_a"], r["value_b"]): r for r in contradictions.identity_contradictions(df).collect()}
    names = got["full_name", "Mohammad Khan", "Mohd Khan"]
    assert (names["classification"], names["reason"], names["n_a"], names["document_a"]) == ("harmless", "abbreviation", 2, 11)
    doubted = got["full_name", "Mohd Khan", "Ravi Sen"]
    assert (doubted["reason"], doubted["severity"], doubted["was_reason"], doubted["was_severity"]) == ("unclear_reading", "medium", "different_name", "critical")
    assert ("id_number", "1234-5678", "XXXX5678") not in got and got["id_number", "1234-5678", "12345679"]["severity"] == "high"
    assert got["annual_income", "100", "200"]["severity"] == "critical" and ("annual_income", "100", "900") not in got
    assert got["address", "12 MG Rd 400001", "12 Mahatma Gandhi Road 400001"]["classification"] == "harmless"
    assert contradictions.identity_contradictions(df.limit(0)).count() == 0


def test_values_of_any_length(spark):
    rows = spark.createDataFrame([("1234567890123",), ("12.34567891",), ("-1,234,567,890,123.5",), (None,)], "t string")
    assert [r[0] for r in rows.select(fn.parse_number(F.col("t"))).collect()] == [1234567890123.0, 12.34567891, -1234567890123.5, None]
    assert len(spark.range(1).select(fn.humanize(F.lit("a_" * 300))).first()[0]) == 599
    names = spark.createDataFrame([("case-1000000000000",), ("case-999999999999",), ("case-0012",), ("case-7",)], "n string")
    assert [r["n"] for r in names.orderBy(operations.natural_key(F.col("n"))).collect()] == ["case-7", "case-0012", "case-999999999999", "case-1000000000000"]
    refs = spark.createDataFrame([("2024/001",), ("INV_1.A #2",), ("-1",), ("abc",), ("",), (None,), ("7" * 500,)], "r string")
    assert [r[0] for r in refs.select(validation.reference_number("r")).collect()] == ["pass", "pass", "flag", "flag", "skipped", "skipped", "pass"]
