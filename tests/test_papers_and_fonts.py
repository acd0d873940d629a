"""Type on pages, signatures, messages, forms, files: nulls, ties, repeats, empty tables and known answers."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from dossier.operators import fonts, invoices, messages, metadata, prefill, signatures

SPANS = "document_id int, page int, span_no int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double, baseline double"


def test_second_copies_of_a_font(spark):
    rows = [
        (1, 1, 1, "Total due now", "AAAAAA+Arial-BoldMT", 9.0, 0.0, 100.0, 80.0, 110.0, 108.0),
        (1, 1, 2, "45.00", "BBBBBB+Arial-Bold", 9.0, 200.0, 104.0, 240.0, 114.0, 112.0),  # on the main copy's row
        (1, 1, 3, "10.00", "AAAAAA+Arial-BoldMT", 9.0, 210.0, 300.0, 240.5, 310.0, 308.0),
        (1, 1, 4, "12.00", "BBBBBB+Arial-Bold", 9.0, 205.0, 500.0, 241.0, 510.0, 508.0),  # in its column, and digits alone
        (1, 1, 5, "word", "CCCCCC+Arial-BoldMT", 9.0, 900.0, 700.0, 940.0, 710.0, 708.0),  # nowhere near
        (1, 1, 6, "x", "Arial", 9.0, 0.0, 0.0, 1.0, 1.0, 1.0),
        (1, 1, 7, "--", "BBBBBB+Arial-Bold", 9.0, 0.0, 100.0, 1.0, 110.0, 108.0),
        (2, 1, 1, "only one copy", "AAAAAA+Arial", 9.0, 0.0, 0.0, 9.0, 9.0, 9.0),
        (3, 1, 1, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows + rows[:4], SPANS)
    got = {r["span_no"]: r for r in fonts.font_subset_split(df).collect()}
    assert set(got) == {2, 4} and all(r["main_subset"] == "AAAAAA" and r["subset"] == "BBBBBB" for r in got.values())
    assert got[2]["row_text"] == "Total due now" and got[4]["row_text"] is None and got[4]["column_text"] == "10.00" and got[4]["digits_only"]
    assert fonts.font_subset_split(df.limit(0)).count() == 0
    families = spark.createDataFrame([("ABCDEF+Helvetica-Oblique",), ("ArialMT",), ("Arial,Bold",), ("Comic Sans MS-Bold-6003",), ("TimesNewRomanPS-BoldMT",), (None,)], "f string")
    assert [r[0] for r in families.select(fonts.font_family(F.col("f"))).collect()][:4] == ["arial", "arial", "arial", "comicsansms"]


def test_converted_scans_and_size_steps(spark):
    rows = [(1, 1, 1, "7", "Arial", 10.0, 50.0, 0.0, 60.0, 10.0, 100.0), (1, 1, 2, "a", "F-1234", 10.5, 0.0, 0.0, 40.0, 10.0, 101.0), (1, 1, 3, "b", "F-9999", 10.0, 61.0, 0.0, 70.0, 10.0, 102.5), (1, 1, 4, "c", "F-9999", 20.0, 60.0, 0.0, 70.0, 10.0, 102.0), (1, 1, 5, "d", "Arial", 10.0, 0.0, 0.0, 9.0, 9.0, 200.0)]
    df = spark.createDataFrame(rows + rows[:2], SPANS)
    got = fonts.converted_scan_runs(df).collect()
    assert [(r["span_no"], r["peer_no"], r["words_in_this_font"]) for r in got] == [(1, 3, 1)]
    line = [(1, 1, 1, i, c, float(s)) for i, (c, s) in enumerate(zip("12 34.5 x7 8", [9, 9, 9, 9, 9, 9.2, 9, 1, 9, 5, 1, 9], strict=True))]
    steps = fonts.number_size_steps(spark.createDataFrame(line + line[:3], "document_id int, page int, line_no int, char_no int, ch string, size double")).collect()
    assert [(r["text"], r["first_char"], r["smallest"], r["largest"]) for r in steps] == [("34.5", 3, 9.0, 9.2)]


def test_template_dates(spark):
    near, far = "REV 2 Issue No 5 ", "REV 2 " + "x" * 300 + " Issue No 5 "
    rows = [(1, near + "Date of Issue: 14.03.22 end"), (2, far + "Date of Issue: 14.03.2022"), (3, near + "DATE OF ISSUE - 31/02/2022"), (4, None), (5, ""), (6, (near + "Date of issue 1-2-2020 ") * 2000)]
    got = fonts.template_dates(spark.createDataFrame(rows, "document_id int, text string")).collect()
    assert [(r["document_id"], r["value"], r["raw_text"]) for r in got if r["document_id"] < 6] == [(1, "2022-03-14", "14.03.22")]
    assert sum(r["document_id"] == 6 for r in got) == 2000


def test_template_date_markers_are_those_of_the_window():
    """A word that the window's edge cuts counts by what is left of it, as a search in the cut-out text finds it."""
    date = "DATE OF ISSUE - 14.03.2022"
    front = "prerev " + "x" * (200 - len("rev  Issue No 5 ")) + " Issue No 5 "
    assert fonts.template_dates_of(front + date) == [(len(front), "2022-03-14", "14.03.2022")]
    assert fonts.template_dates_of("y" + front[:7] + "x" + front[7:] + date) == []
    back = " Issue No 5 " + "x" * (200 - len(" Issue No 5  rev")) + " revenue"
    assert fonts.template_dates_of(date + back) == [(0, "2022-03-14", "14.03.2022")]
    assert fonts.template_dates_of(date + " " + back) == []
    assert len(fonts.template_dates_of("pour" + chr(233) + "rev Issue No 5 " + date)) == 1


def test_signatures(spark):
    box = "struct<x:double,y:double,width:double,height:double>"
    words = spark.createDataFrame([(1, 1, i, t, 0.1 * i, 0.1, 0.08, h, hw) for i, (t, h, hw) in enumerate([("Ali", 0.02, False), ("Khan", 0.02, False), ("scrawl", 0.05, True), (" ", 0.02, True), ("note", 0.02, True)])], "document_id int, page int, word_no int, text string, x double, y double, width double, height double, handwritten boolean")
    found = spark.createDataFrame([(1, None, None, 0.1, 0.1, 0.05, 0.02), (1, 1, "stamp", 0.0, 0.0, 1.0, 1.0)], "document_id int, page int, kind string, x double, y double, width double, height double")
    ink = signatures.signature_words(words, found)
    assert sorted(r["text"] for r in ink.collect()) == ["Khan", "scrawl"]
    fields = spark.createDataFrame([(1, "prepared_by", "Ali Khan, Khan", None, None), (1, "approved_by", "scrawl", None, None), (1, "remarks", "Khan", None, None), (1, "checked_by", "Khan", 2, (0.0, 0.0, 1.0, 1.0)), (1, "verified", None, None, None)], f"document_id int, field string, value string, page int, box {box}")
    got = {r["field"]: (r["value"], r["value_as_read"]) for r in signatures.strip_signature_text(fields, ink).collect()}
    assert got == {"prepared_by": ("Ali", "Ali Khan, Khan"), "approved_by": (None, "scrawl"), "remarks": ("Khan", None), "checked_by": ("Khan", None), "verified": (None, None)}
    signs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "document_id int, vector array<double>")
    docs = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (7, 4), (8, 5)], "case_id int, document_id int")
    compared = {r["document_id"]: r["reason"] for r in signatures.reference_signature_compare(signs, spark.createDataFrame([(7, 1), (8, 5)], "case_id int, document_id int"), docs).collect()}
    assert compared == {2: "signature_match", 3: "signature_mismatch", 4: "signature_absent"}


def test_messages(spark):
    rows = spark.createDataFrame([("{a} and {b}{c}", {"a": "{b}", "b": "x"}), ("{a", {"a": "1"}), ("", {}), (None, {"a": "1"})], "t string, m map<string,string>")
    assert [r[0] for r in rows.select(messages.render_reason(F.col("t"), F.col("m"))).collect()] == ["{b} and x", "{a", "", None]
    header = spark.createDataFrame([("8/18/23, 12:54 PM\nx",), ("\n a\n 2/3/2024 1:05",), ("a\nb\n1/2/23, 1:00",), ("31/31/23, 1:00",), (None,)], "t string")
    d = datetime.date
    assert [r[0] for r in header.select(messages.print_header_dates(F.col("t"))).collect()] == [[d(2023, 8, 18)], [d(2024, 2, 3), d(2024, 3, 2)], [], [], []]
    findings = spark.createDataFrame([("conflict", "a_b", {"x": "1"}), ("conflict", "c", {"x": "2"}), ("harmless", "d_e", {})], "classification string, reason string, context map<string,string>")
    templates = spark.createDataFrame([("conflict", "a_b", "own {x}"), ("conflict", None, "common {x}")], "classification string, reason string, template string")
    assert {r["reason"]: r["description"] for r in messages.describe_findings(findings, templates).collect()} == {"a_b": "own 1", "c": "common 2", "d_e": "d e."}


def test_forms_and_schemes(spark):
    profiles = spark.createDataFrame([(1, "full_name", "agreed", "A", 5), (1, "date_of_birth", "agreed", "2000-03-11", 6), (1, "address", "conflict", "x 123456", 7), (2, "address", "agreed", "no code", 8)], "case_id int, field string, status string, value string, document_id int")
    forms = spark.createDataFrame([("f", "t", i, s or "free", s) for i, s in enumerate(["full_name", "age", "postal_code", None])], "form_id string, case_type string, position int, key string, source string")
    got = prefill.form_prefill(spark.createDataFrame([(1, "t"), (2, "t"), (3, "u")], "case_id int, case_type string"), profiles, forms, "2024-03-10")
    assert {(r["case_id"], r["key"]): (r["status"], r["value"]) for r in got.collect()} == {(1, "full_name"): ("filled", "A"), (1, "age"): ("filled", "23"), (1, "postal_code"): ("needs_attention", None), (1, "free"): ("to_fill", None), **{(2, k): ("to_fill", None) for k in ("full_name", "age", "postal_code", "free")}}
    assert {r["case_id"]: (r["filled"], r["ready"]) for r in prefill.form_counts(got).collect()} == {1: (2, False), 2: (0, True)}


def test_files_and_invoices(spark):
    docs = spark.createDataFrame([(1, "Adobe XMP Core", None, "", None, "a", "a", False), (2, "x", "p", None, None, "a", "b", True), (3, None, None, None, None, None, None, None)], "document_id int, toolkit string, producer string, creator string, xmp_producer string, original_id string, current_id string, scanned boolean")
    steps = spark.createDataFrame([(2, 1, "edited", "GIMP"), (3, 1, None, None), (3, 2, "saved", "x")], "document_id int, step int, action string, agent string")
    assert sorted((r["document_id"], r["finding"]) for r in metadata.history_findings(docs, steps).collect()) == [(1, "producer_scrubbed"), (2, "document_id_chain"), (2, "history_editing_tool_anomaly"), (2, "history_scanned_document_edited"), (2, "xmp_history"), (3, "xmp_history")]
    heads = spark.createDataFrame([(1, 1, 10.0, 1.0, 11.0, 10.0), (1, 2, 10.0, 0.5, 11.0, 5.0), (2, 1, None, None, None, None)], "document_id int, invoice_no int, subtotal double, tax double, total double, rate double")
    lines = spark.createDataFrame([(1, 1, 2.0, 5.0, 10.0), (1, 2, 2.0, 4.0, 10.0)], "document_id int, invoice_no int, quantity double, unit_price double, total double")
    known = spark.createDataFrame([(1, "line_item_arithmetic"), (1, "line_item_arithmetic")], "document_id int, sub_check string")
    got = {r["document_id"]: (r["problems"], r["repeats"], r["status"]) for r in invoices.per_invoice(heads, lines, known).collect()}
    assert got == {1: (1, 1, "flag"), 2: (0, 0, "skipped")}
