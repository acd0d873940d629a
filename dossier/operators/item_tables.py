"""Line items of printed tables and of rate lines, and their merge with items read before.

A table is its cells (document_id, table_no, row_index, column_index, content), or a document its whole tables (see
``whole_documents``). Header rows are told by their labels, and the rows below a header are read up to the first that ends
it, all inside the document's own row: nothing is joined.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.text import cell_amount

# Printed numbers, and the labels by which columns and rows are told.
NUMBER = r"[0-9]{1,3}(?:,\s?[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?"
TOTAL_LABEL = r"(?i)\b(?:grand\s+)?total\b|\bnet\s+payable\b|\bamount\s+due\b|\bbalance\s+due\b"
SUBTOTAL_LABEL = r"(?i)\bsub\s*-?\s*total\b"
TAX_LABEL = r"(?i)\b(?:vat|tax|gst)\b"
DESCRIPTION_LABEL = r"(?i)\b(?:description|particulars|details?|items?)\b"
AMOUNT_LABEL = r"(?i)\b(?:amount|amt|price|value|aed|usd)\b"
#: Roles of amount columns in the order in which a label is tried.
ROLES = (
    ("total", r"(?i)\btotal\b"),
    ("vat", r"(?i)\b(?:vat|tax|gst)\b(?!.*%)"),
    ("net", r"(?i)\bnet\b"),
    ("discount", r"(?i)\bdisc(?:ount)?\b"),
    ("price", r"(?i)\b(?:price|amount|amt|rate|value|gross)\b"),
)
ONE_NUMBER = rf"^\s*(?:[A-Z]{{3}}\s*)?({NUMBER})\s*(?:[A-Z]{{3}})?\s*$"
ONLY_NUMBERS = rf"^\s*(?:(?:[A-Z]{{3}}\s*)?(?:{NUMBER})\s*)+$"
RATE_LINE = rf"(?i)({NUMBER})\s*(?:[A-Z]{{3}}\s+)?PER\s+([A-Z]+?)S?\s*[X×*]\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Z]+)?\s*=\s*({NUMBER})"
ITEM_START = r"^\s*[0-9]{1,2}\s*[.)]\s+\S"
#: Lines above a rate line that its item may begin on, and columns of charges that a table of one row has.
LOOK_BACK, LEAST_CHARGES = 4, 2


def printed_number(text: Column) -> Column:
    return F.regexp_replace(text, r"[,\s]", "").try_cast("double")


def whole_documents(cells: DataFrame) -> DataFrame:
    """Rows (document_id, tables): the tables of a document, structs (table_no, rows of (row_index, cells of (col, text))), each in
    order; of several contents of one place the last in order counts. A null content is empty.

    Rows that have ``tables`` already are taken as they are. Else all cells are dealt out once, by document, so that nothing
    after that shuffles: the parsers work on one document at a time, which a task holds in memory.
    """
    if "tables" in cells.columns:
        return cells.select("document_id", "tables")
    text = F.trim(F.coalesce("content", F.lit("")))
    put = lambda df, keys, name, *parts: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias(name))
    placed = cells.repartition("document_id").groupBy("document_id", "table_no", "row_index", F.col("column_index").alias("col")).agg(F.max(text).alias("text"))
    rows = put(placed, ["document_id", "table_no", "row_index"], "cells", "col", "text")
    return put(put(rows, ["document_id", "table_no"], "rows", "row_index", "cells"), ["document_id"], "tables", "table_no", "rows")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _at(cells: Column, col: Column) -> Column:
    """The text of a column of a row, empty where the row has no such cell."""
    return F.coalesce(F.get(F.filter(cells, lambda c: c["col"] == col), F.lit(0))["text"], F.lit(""))


def _first_good(cells: DataFrame, found: Callable[[Column], Column]) -> DataFrame:
    """Rows (document_id, one): of all that ``found`` gives for the tables of a document, arrays of structs, the first."""
    # as a generator it is worked out once; the planner would repeat a projected column in the filters that it pushes down
    first = F.explode_outer(F.slice(F.flatten(F.transform("tables", found)), 1, 1)).alias("one")
    return whole_documents(cells).select("document_id", first).filter("one IS NOT NULL")


def parse_single_row_table(cells: DataFrame) -> DataFrame:
    """Rows (document_id, table_no, kind, column, label, amount, rate) of the first table of a document that has two rows, labels
    and amounts, a total and LEAST_CHARGES other charges. kind is item, subtotal, total or tax_amount (with the rate of its
    label); of several columns of the last three the last counts. Cells that are no number are passed over."""
    kind = lambda t: F.when(t.rlike(SUBTOTAL_LABEL), "subtotal").when(t.rlike(TOTAL_LABEL), "total").when(t.rlike(TAX_LABEL), "tax_amount").otherwise("item")

    def charges(head: Column, body: Column) -> Column:
        numbered = F.transform(head, lambda h: F.struct(h["col"].alias("column"), h["text"].alias("label"), F.regexp_extract(_at(body, h["col"]), ONE_NUMBER, 1).alias("number")))
        return F.transform(F.filter(numbered, lambda r: (r["label"] != "") & (r["number"] != "")), lambda r: F.struct(kind(r["label"]).alias("kind"), r["column"].alias("column"), r["label"].alias("label"), r["number"].alias("number")))

    def found(t: Column) -> Column:
        two = F.filter(F.array(t["rows"]), lambda rows: F.size(rows) == 2)
        read = F.transform(two, lambda rows: F.struct(t["table_no"].alias("table_no"), charges(rows[0]["cells"], rows[1]["cells"]).alias("read")))
        items = lambda r: F.size(F.filter(r, lambda c: c["kind"] == "item"))
        return F.filter(read, lambda x: F.exists(x["read"], lambda c: c["kind"] == "total") & (items(x["read"]) >= LEAST_CHARGES))

    first = _first_good(cells, found).select("document_id", F.col("one.table_no").alias("table_no"), F.col("one.read").alias("read"))
    last = F.filter("read", lambda r: (r["kind"] == "item") | ~F.exists("read", lambda o: (o["kind"] == r["kind"]) & (o["column"] > r["column"])))
    each = first.select("document_id", "table_no", F.explode_outer(last).alias("r")).select("document_id", "table_no", "r.*")
    rate = F.when(F.col("kind") == "tax_amount", F.nullif(F.regexp_extract("label", r"([0-9]+(?:\.[0-9]+)?)\s*%", 1), F.lit("")).try_cast("double"))
    return each.select("document_id", "table_no", "kind", "column", "label", printed_number(F.col("number")).alias("amount"), rate.alias("rate"))


def _below(rows: Column, i: Column, read: Callable[[Column], Column]) -> Column:
    """What ``read`` makes of the rows of a table below the one at ``i``, structs with ``ends``, up to the first that ends."""
    below = F.transform(F.slice(rows, i + 2, F.size(rows)), read)
    return _let(below, lambda x: _let(F.array_position(F.transform(x, lambda r: r["ends"]), F.lit(True)).cast("int"), lambda n: F.when(n > 0, F.slice(x, F.lit(1), n)).otherwise(x)))


def column_roles(header: Column) -> Column:
    """Structs (role, col, label) of a header row's cells: a label has the first role that fits, a role the first column;
    columns of rates in percent have none."""
    percent = lambda t: t.rlike(r"(?i)%|\brate\b") & ~t.rlike(r"(?i)\bamount\b")

    def role(text: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, pattern in reversed(ROLES):
            found = F.when(text.rlike(pattern), name).otherwise(found)
        return F.when(~percent(text), found)

    named = F.filter(F.transform(header, lambda c: F.struct(role(c["text"]).alias("role"), c["col"].alias("col"), c["text"].alias("label"))), lambda r: r["role"].isNotNull())
    return _let(named, lambda n: F.filter(n, lambda r: ~F.exists(n, lambda o: (o["role"] == r["role"]) & (o["col"] < r["col"]))))


def parse_multi_column_table(cells: DataFrame) -> DataFrame:
    """Rows (document_id, table_no, row_index, description, line_total, columns) of the first table of a document with a header of at
    least three amount roles, a net or total among them, and two items below it; of several headers the first. columns maps
    roles to amounts. Items end at a row without description or with one of a total; rows without amounts are passed over.
    line_total is the net amount, or else the total."""
    role = dict(ROLES)
    has_amounts = lambda r: (F.size(r["cells"]) >= 3) & F.exists(r["cells"], lambda c: c["text"].rlike(role["net"]) | c["text"].rlike(role["total"]))

    def header(r: Column, i: Column) -> Column:
        described = F.get(F.filter(r["cells"], lambda c: c["text"].rlike(DESCRIPTION_LABEL)), F.lit(0))["col"]
        return F.when(has_amounts(r), F.struct(i.alias("i"), column_roles(r["cells"]).alias("roles"), F.coalesce(described, F.get(r["cells"], F.lit(0))["col"]).alias("described")))

    def amounts(r: Column, roles: Column) -> Column:
        each = F.transform(roles, lambda x: F.struct(x["role"].alias("key"), _let(_at(r["cells"], x["col"]), cell_amount).alias("value")))
        return F.map_from_entries(F.filter(each, lambda e: e["value"].isNotNull()))

    def items(rows: Column, h: Column) -> Column:
        label = lambda r: F.struct(r.alias("row"), _at(r["cells"], h["described"]).alias("label"))
        ended = lambda x: F.struct(x["row"].alias("row"), x["label"].alias("label"), ((x["label"] == "") | x["label"].rlike(TOTAL_LABEL) | x["label"].rlike(SUBTOTAL_LABEL)).alias("ends"))
        live = F.filter(_below(rows, h["i"], lambda r: _let(label(r), ended)), lambda x: ~x["ends"])
        read = F.transform(live, lambda x: F.struct(x["row"]["row_index"].alias("row_index"), x["label"].alias("description"), amounts(x["row"], h["roles"]).alias("columns")))
        return F.filter(read, lambda x: _line_total(x["columns"]).isNotNull())

    def found(t: Column) -> Column:
        headers = F.filter(F.transform(t["rows"], header), lambda h: (F.size(h["roles"]) >= 3) & F.exists(h["roles"], lambda r: r["role"].isin("net", "total")))
        return F.filter(F.transform(headers, lambda h: F.struct(t["table_no"].alias("table_no"), items(t["rows"], h).alias("items"))), lambda x: F.size(x["items"]) >= 2)

    each = _first_good(cells, found).select("document_id", F.col("one.table_no").alias("table_no"), F.explode_outer("one.items").alias("x")).select("document_id", "table_no", "x.*")
    return each.select("document_id", "table_no", "row_index", "description", _line_total(F.col("columns")).alias("line_total"), "columns")


def _line_total(columns: Column) -> Column:
    return F.coalesce(F.try_element_at(columns, F.lit("net")), F.try_element_at(columns, F.lit("total")))


def parse_stacked_table(cells: DataFrame) -> DataFrame:
    """Rows (document_id, table_no, item_no, description, line_total, total) of the first table of a document with a description and an
    amount column in whose rows several lines are stacked in one cell: descriptions and amounts, in order, must be equally
    many and two at least. Rows end at one of a total or tax; total is the amount of such a row of a total with one number.
    A cell of the amount column that holds more than numbers before that spoils the header."""

    def header(r: Column, i: Column) -> Column:
        described = F.get(F.filter(r["cells"], lambda c: c["text"].rlike(DESCRIPTION_LABEL)), F.lit(0))["col"]
        amounts = lambda d: F.get(F.filter(r["cells"], lambda c: (c["col"] != d) & c["text"].rlike(AMOUNT_LABEL)), F.lit(0))["col"]
        return _let(described, lambda d: F.struct(i.alias("i"), d.alias("described"), F.when(d.isNotNull(), amounts(d)).alias("amounts")))

    def told(label: Column, cell: Column) -> Column:
        spoiled, total, subtotal = (cell != "") & ~cell.rlike(ONLY_NUMBERS), label.rlike(TOTAL_LABEL), label.rlike(SUBTOTAL_LABEL)
        names = lambda k: F.struct(label.alias("label"), cell.alias("cell"), k["spoiled"].alias("spoiled"), (k["total"] & ~k["subtotal"]).alias("total"), (k["spoiled"] | k["total"] | k["subtotal"] | label.rlike(TAX_LABEL)).alias("ends"))
        return _let(F.struct(spoiled.alias("spoiled"), total.alias("total"), subtotal.alias("subtotal")), names)

    def stack(rows: Column, h: Column) -> Column:
        texts = lambda r: F.struct(_at(r["cells"], h["described"]).alias("label"), _at(r["cells"], h["amounts"]).alias("cell"))
        below = _below(rows, h["i"], lambda r: _let(texts(r), lambda x: told(x["label"], x["cell"])))
        values = lambda x: F.regexp_extract_all(x["cell"], F.lit(f"({NUMBER})"), F.lit(1))
        lines = lambda x: F.filter(F.transform(F.split(x["label"], r"\R"), lambda line: F.trim(line)), lambda line: line != "")
        live = lambda b: F.transform(F.filter(b, lambda x: ~x["ends"]), lambda x: F.struct(lines(x).alias("lines"), values(x).alias("values")))
        total = lambda b: F.get(F.filter(F.transform(F.filter(b, lambda x: x["total"] & ~x["spoiled"]), values), lambda v: F.size(v) == 1), F.lit(0))[0]
        return _let(below, lambda b: F.struct(F.exists(b, lambda x: x["spoiled"]).alias("spoiled"), total(b).alias("total"), live(b).alias("live")))

    def found(t: Column) -> Column:
        headers = F.filter(F.transform(t["rows"], header), lambda h: h["amounts"].isNotNull())
        whole = F.filter(F.transform(headers, lambda h: stack(t["rows"], h)), lambda x: ~x["spoiled"] & F.exists(x["live"], lambda r: (F.size(r["lines"]) > 1) | (F.size(r["values"]) > 1)))
        in_order = lambda x, c: F.flatten(F.transform(x["live"], lambda r: r[c])).alias(c)
        each = F.transform(whole, lambda x: F.struct(t["table_no"].alias("table_no"), x["total"].alias("total"), in_order(x, "lines"), in_order(x, "values")))
        return F.filter(each, lambda x: (F.size(x["lines"]) >= 2) & (F.size(x["lines"]) == F.size(x["values"])))

    first = _first_good(cells, found).select("document_id", "one.*")
    items = first.select("document_id", "table_no", printed_number(F.col("total")).alias("total"), F.posexplode_outer(F.arrays_zip("lines", "values")).alias("item_no", "i"))
    return items.select("document_id", "table_no", "item_no", F.col("i.lines").alias("description"), printed_number(F.col("i.values")).alias("line_total"), "total")


def parse_rate_lines(texts: DataFrame) -> DataFrame:
    """Rows (document_id, line_no, description, unit_price, unit, quantity, line_total, status) of every "rate PER unit X quantity =
    amount" in the lines of the rows (document_id, text).

    The item of such a line begins on the nearest numbered line, at most LOOK_BACK lines above and not beyond another rate
    line, else on the line itself; its description is what its first line says before details. status is paid or due as the
    item's lines say; due if both."""
    lined = texts.filter("text IS NOT NULL").select("document_id", F.split("text", r"\R").alias("lines")).select("document_id", "lines", F.posexplode("lines").alias("line_no", "line"))
    rate = lined.filter(F.col("line").rlike(RATE_LINE))
    back = F.sequence(F.lit(0), F.least(F.lit(LOOK_BACK), F.col("line_no")))
    line_at = lambda i: F.get("lines", F.col("line_no") - i)
    start = F.get(F.filter(back, lambda i: line_at(i).rlike(ITEM_START)), F.lit(0))
    edge = F.get(F.filter(back, lambda i: (i > 0) & line_at(i).rlike(RATE_LINE)), F.lit(0))
    above = F.when(start.isNotNull() & (edge.isNull() | (start <= edge)), start).otherwise(0)
    placed = rate.withColumn("above", above).withColumn("block", F.slice("lines", F.col("line_no") - F.col("above") + 1, F.col("above") + 1))
    block = F.array_join("block", " ")
    paid, due = block.rlike(r"(?i)\bPAID\b"), block.rlike(r"(?i)\bDUE\b")
    first = F.regexp_replace(F.get("block", F.lit(0)), r"^\s*[0-9]{1,2}\s*[.)]\s*", "")
    parts = F.array(*(F.regexp_extract_all(F.col("line"), F.lit(RATE_LINE), F.lit(g)) for g in range(6)))
    # a line that is its own item is described by what stands before its first rate
    own = F.when(F.col("above") == 0, F.get(F.split(first, RATE_LINE, 2), F.lit(0))).otherwise(first)
    text = F.regexp_replace(F.get(F.split(own, r"(?i)\s+(?:NUMBER OF\b|FEE\s*:)", 2), F.lit(0)), r"(?i)\s*(?:FEE\s*:)?\s*$", "")
    text = F.trim(text, F.lit(" :-"))
    each = placed.select("document_id", "line_no", text.alias("text"), F.when(due, "due").when(paid, "paid").alias("status"), F.posexplode(F.arrays_zip(*(F.get(parts, F.lit(g)).alias(f"g{g}") for g in range(6)))).alias("nth", "m"))
    m = lambda g: F.col(f"m.g{g}")
    return each.select("document_id", "line_no", "nth", F.coalesce(F.nullif("text", F.lit("")), m(0)).alias("description"), printed_number(m(1)).alias("unit_price"), F.upper(m(2)).alias("unit"), m(3).cast("double").alias("quantity"), printed_number(m(5)).alias("line_total"), "status")


def merge_line_items(existing: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows (document_id, place, source, description, line_total, box) of a document's items after ``parsed`` (document_id, place, source,
    description, line_total) replaces what ``existing`` (the same, and box) has of it.

    A parsed item takes the place, and the box, of the existing one of its source, description and amount; else, in order, of
    the next existing one of source "llm" of its amount: they are told by (document, amount, occurrence), so a second merge
    changes nothing. What is left of ``existing`` stays, what is left of ``parsed`` follows. Parsed items of one source,
    description and amount are one. Amounts are compared in cents; items without amount replace nothing."""
    kind = existing.schema["box"].dataType
    every = existing.select("document_id", F.lit(0).alias("part"), "place", "source", "description", "line_total", "box")
    every = every.unionByName(parsed.select("document_id", F.lit(1).alias("part"), "place", "source", "description", "line_total", F.lit(None).cast(kind).alias("box")))
    # dealt out once, by document: all windows below are of one document, so they only sort
    every = every.repartition("document_id").withColumn("cents", F.round(F.col("line_total") * 100).cast("long"))
    item, amount = ["document_id", "source", "description", "cents"], ["document_id", "cents"]
    old, new = F.col("part") == 0, F.col("part") == 1
    told = lambda keys: reduce(and_, (F.col(k).isNotNull() for k in keys))
    # of parsed items of one source, description and amount the first stays; it takes the place of the first such existing item
    first = F.row_number().over(W.partitionBy(*item, "part").orderBy("place", "line_total"))
    every = every.withColumn("nth", first).filter(old | (F.col("nth") == 1)).drop("nth")
    again = F.min(F.when(old & (F.col("source") != "llm"), F.col("place"))).over(W.partitionBy(*item))
    every = every.withColumn("hit", F.when(new & told(item), again))
    # the others are dealt to the existing ones of "llm", the first of an amount to the first, and so on
    role = F.when(new & F.col("hit").isNull(), "fresh").when(old & (F.col("source") == "llm"), "open")
    every = every.withColumn("role", role).withColumn("nth", F.row_number().over(W.partitionBy(*amount, "role").orderBy("place")))
    given = F.min(F.when(F.col("role") == "open", F.col("place"))).over(W.partitionBy(*amount, F.when(F.col("role").isNotNull(), F.col("nth"))))
    every = every.withColumn("hit", F.when((F.col("role") == "fresh") & told(amount), given).otherwise(F.col("hit")))
    # what takes a place meets the item that has it
    target = F.when(old, F.col("place")).otherwise(F.col("hit"))
    put = F.max(F.when(new, F.struct("source", "description", "line_total"))).over(W.partitionBy("document_id", "target"))
    every = every.withColumn("target", target).withColumn("put", F.when(old & told(["document_id", "place"]), put)).filter(old | F.col("hit").isNull())
    hit = F.col("put").isNotNull()
    now = {c: F.when(hit, F.col(f"put.{c}")).otherwise(F.col(c)) for c in ("source", "description", "line_total")}
    return every.withColumn("at", F.row_number().over(W.partitionBy("document_id").orderBy("part", "place"))).select("document_id", F.col("at").alias("place"), *(c.alias(n) for n, c in now.items()), "box")
