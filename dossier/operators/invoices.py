"""Files of several invoices: each column against its total, each invoice by itself, the invoice of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far a sum of n printed amounts may be from a printed total: a cent for each of them.
CENT, SLACK = 0.01, 1e-9


def multi_column_sums(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (document_id, role, column_sum, printed, n, status) of each role of amounts of the items (document_id, columns: a map of
    roles to amounts): its sum against the printed total (document_id, role, value) of the same role.

    flag where they differ by more than a cent for each amount, skipped where no total is printed. Columns are never mixed;
    of several totals of a role the smallest is taken."""
    each = items.select("document_id", F.explode("columns").alias("role", "amount")).filter("amount IS NOT NULL")
    sums = each.groupBy("document_id", "role").agg(F.sum(F.col("amount").cast("decimal(18,4)")).cast("double").alias("column_sum"), F.count("*").alias("n"))
    printed = totals.groupBy("document_id", "role").agg(F.min("value").alias("printed"))
    joined = sums.join(printed, ["document_id", "role"], "left")
    status = F.when(F.col("printed").isNull(), "skipped").when(F.abs(F.col("column_sum") - F.col("printed")) > CENT * F.col("n") + SLACK, "flag").otherwise("pass")
    return joined.select("document_id", "role", "column_sum", "printed", "n", status.alias("status"))


def per_invoice(invoices: DataFrame, lines: DataFrame, flagged: DataFrame) -> DataFrame:
    """Rows (document_id, invoices, problems, repeats, status) of every document of ``invoices`` (document_id, invoice_no, subtotal, tax,
    total, rate): four checks of each invoice with its lines (document_id, invoice_no, quantity, unit_price, total).

    The checks are those of line arithmetic, of the lines' sum against the subtotal, of subtotal and tax against the total,
    and of tax against its rate. A kind of problem that ``flagged`` (document_id, sub_check) already holds against the
    document is a repeat, no problem of its own. skipped for a file of one invoice; a check lacking a value passes."""
    wrong = F.abs(F.col("quantity") * F.col("unit_price") - F.col("total")) > 0.02 + 0.005 * F.col("quantity") + SLACK
    sums = lines.groupBy("document_id", "invoice_no").agg(F.count_if(wrong).alias("wrong"), F.count("total").alias("n"), F.sum(F.col("total").cast("decimal(18,4)")).cast("double").alias("sum"))
    each = invoices.join(sums, ["document_id", "invoice_no"], "left")
    c = F.col
    checks = {
        "line_item_arithmetic": c("wrong") > 0,
        "subtotal_line_item_consistency": F.abs(c("sum") - c("subtotal")) > CENT * F.greatest(c("n"), F.lit(1)) + SLACK,
        "total_tax_consistency": F.abs(c("subtotal") + c("tax") - c("total")) > 2 * CENT + SLACK,
        "tax_rate_consistency": F.abs(c("subtotal") * c("rate") / 100 - c("tax")) > CENT + SLACK,
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for name, when in checks.items())))
    problems = each.select("document_id", "invoice_no", F.explode(found).alias("sub_check"))
    known = flagged.select("document_id", "sub_check").distinct().withColumn("known", F.lit(True))
    counted = problems.join(known, ["document_id", "sub_check"], "left").groupBy("document_id").agg(F.count_if(F.col("known").isNull()).alias("problems"), F.count("known").alias("repeats"))
    files = invoices.groupBy("document_id").agg(F.countDistinct("invoice_no").alias("invoices"))
    out = files.join(counted, "document_id", "left").fillna(0, ["problems", "repeats"])
    one = F.col("invoices") < 2
    return out.select("document_id", "invoices", *(F.when(one, F.lit(0).cast("long")).otherwise(F.col(x)).alias(x) for x in ("problems", "repeats")), F.when(one, "skipped").when(F.col("problems") > 0, "flag").otherwise("pass").alias("status"))


def invoice_on_page(invoices: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (document_id, page, more) with the invoice_no whose pages (document_id, invoice_no, pages) hold the page; of several
    the first, null for none. Pages are put in rows once, so a page is looked up by equality."""
    placed = invoices.select("document_id", "invoice_no", F.explode("pages").alias("page")).groupBy("document_id", "page").agg(F.min("invoice_no").alias("invoice_no"))
    return asked.join(placed, ["document_id", "page"], "left")
