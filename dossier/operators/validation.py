"""Checks on the numbers and dates of a document. Each gives one row for a document with pass, flag or skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLACK = 1e-9


def rounding_allowance(terms: Column) -> Column:
    return 0.01 * F.greatest(terms, F.lit(1)) + SLACK


def status(flagged: Column, known: Column | None = None) -> Column:
    found = F.when(flagged, "flag").otherwise("pass")
    return found if known is None else F.when(known, found).otherwise("skipped")


def chk_line_item_arithmetic(lines: DataFrame) -> DataFrame:
    """Rows (document_id, n_lines, n_wrong, status) of lines (document_id, quantity, unit_price, discount, total)."""
    off = F.abs(F.col("quantity") * F.col("unit_price") - F.coalesce("discount", F.lit(0.0)) - F.col("total"))
    wrong = F.coalesce(off > 0.02 + 0.005 * F.col("quantity") + SLACK, F.lit(False))
    n = lines.groupBy("document_id").agg(F.count("*").alias("n_lines"), F.count_if(wrong).alias("n_wrong"))
    return n.withColumn("status", status(F.col("n_wrong") > 0))


def chk_line_items_sum(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (document_id, line_sum, difference, status): lines (document_id, total) against document totals."""
    sums = lines.groupBy("document_id").agg(F.sum(F.col("total").cast("decimal(18,4)")).cast("double").alias("line_sum"), F.count("*").alias("n"))
    joined = documents.select("document_id", "total_amount").join(sums, "document_id", "left")
    off = F.abs(F.col("line_sum") - F.col("total_amount"))
    return joined.select("document_id", "line_sum", F.round(off, 2).alias("difference"), status(off > rounding_allowance(F.col("n")), off.isNotNull()).alias("status"))


def chk_total_tax(documents: DataFrame, allowance: float = 0.02) -> DataFrame:
    """Rows (document_id, status): total = subtotal + tax, or = subtotal where no tax is shown."""
    off = F.abs(F.col("subtotal") + F.coalesce("tax", F.lit(0.0)) - F.col("total_amount"))
    return documents.select("document_id", status(off > allowance + SLACK, off.isNotNull()).alias("status"))


def chk_date_in_future(documents: DataFrame, today: str) -> DataFrame:
    late = F.col("document_date") > F.lit(today).cast("timestamp")
    return documents.select("document_id", status(late, F.col("document_date").isNotNull()).alias("status"))


def chk_multiple_invoices(documents: DataFrame) -> DataFrame:
    """Rows (case_id, month, n_documents) of months in which a case has two documents or more."""
    month = F.date_format("document_date", "yyyy-MM")
    return documents.groupBy("case_id", month.alias("month")).agg(F.count("*").alias("n_documents")).filter("n_documents > 1")


def chk_tax_rate(lines: DataFrame) -> DataFrame:
    """Rows (document_id, n_rates, top_rate, status): a document with lines of more than one tax rate is flagged."""
    rates = lines.groupBy("document_id").agg(F.countDistinct("tax_rate").alias("n_rates"), F.max("tax_rate").alias("top_rate"))
    return rates.withColumn("status", status(F.col("n_rates") > 1))


def chk_date_sequence(documents: DataFrame) -> DataFrame:
    """Rows (document_id, n_early, n_lines, status): line dates before the document's date are out of sequence."""
    early = F.count_if(F.col("line_date") < F.col("document_date"))
    found = documents.groupBy("document_id").agg(early.alias("n_early"), F.count("line_date").alias("n_lines"))
    return found.withColumn("status", status(F.col("n_early") > 0, F.col("n_lines") > 0))


def sub_checks(documents: DataFrame, checked: dict[str, DataFrame]) -> DataFrame:
    """One long table (company_id, case_id, document_id, sub_check, status) of several checks' results."""
    out = None
    for name, found in checked.items():
        rows = found.select("document_id", F.lit(name).alias("sub_check"), "status")
        out = rows if out is None else out.unionByName(rows)
    return documents.select("company_id", "case_id", "document_id").join(out, "document_id")


def document_checks(documents: DataFrame, lines: DataFrame, today: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Five checks of every document in one pass over the lines: rows (keep, document_id, sub_check, status), with the
    columns ``keep`` of ``documents``.

    ``lines`` (document_id, quantity, unit_price, discount, total, tax_rate, line_date) are aggregated once for all
    measures, and the result meets ``documents`` (document_id, total_amount, document_date) in one join. A check that a
    document has no lines for gives no row, as the single checks do.
    """
    off = F.abs(F.col("quantity") * F.col("unit_price") - F.coalesce("discount", F.lit(0.0)) - F.col("total"))
    wrong = F.coalesce(off > 0.02 + 0.005 * F.col("quantity") + SLACK, F.lit(False))
    measures = lines.groupBy("document_id").agg(
        F.count("*").alias("n"),
        F.count("unit_price").alias("n_priced"),
        F.count_if(wrong).alias("n_wrong"),
        F.sum(F.col("total").cast("decimal(18,4)")).cast("double").alias("line_sum"),
        F.min("tax_rate").alias("low_rate"),
        F.max("tax_rate").alias("top_rate"),
        F.min("line_date").alias("first_date"),
    )
    d = documents.select(*keep, "document_id", "total_amount", "document_date").join(measures, "document_id", "left")
    apart = F.abs(F.col("line_sum") - F.col("total_amount"))
    checks = {
        "line_item_arithmetic": F.when(F.col("n_priced") > 0, status(F.col("n_wrong") > 0)),
        "line_items_sum": status(apart > rounding_allowance(F.col("n")), apart.isNotNull()),
        "date_in_future": status(F.col("document_date") > F.lit(today).cast("timestamp"), F.col("document_date").isNotNull()),
        "date_sequence": status(F.col("first_date") < F.col("document_date"), F.col("first_date").isNotNull()),
        "tax_rate": F.when(F.col("n") > 0, status(F.col("low_rate") < F.col("top_rate"))),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("sub_check"), c.alias("status")) for k, c in checks.items()))
    return d.select(*keep, "document_id", F.explode(rows).alias("c")).select(*keep, "document_id", "c.sub_check", "c.status").filter("status IS NOT NULL")


def chk_installments(lines: DataFrame, near: float = 0.2) -> DataFrame:
    """Rows (document_id, split, parent, status) of lines (document_id, total, is_part): two instalments or more add up to
    the line that they split.

    That line is one whose total is their sum, or else the largest other, if it is no smaller than any instalment
    and within ``near`` of the sum; then the document is flagged. Without such a line it is skipped.
    """
    exact = lambda c: F.sum(F.when(c, F.col("total").cast("decimal(18,4)"))).cast("double")
    parts = lines.groupBy("document_id").agg(F.count_if("is_part").alias("n"), exact(F.col("is_part")).alias("split"), F.max(F.when(F.col("is_part"), F.col("total"))).alias("largest"))
    others = lines.filter("NOT is_part").select("document_id", "total").join(parts.filter("n >= 2"), "document_id")
    hit = F.abs(F.col("total") - F.col("split")) <= rounding_allowance(F.col("n"))
    found = others.groupBy("document_id").agg(F.min(F.when(hit, F.col("total"))).alias("exact"), F.max("total").alias("other"))
    joined = parts.join(found, "document_id", "left")
    close = (F.col("other") >= F.col("largest")) & (F.abs(F.col("other") - F.col("split")) <= near * F.col("other"))
    verdict = F.when(F.col("exact").isNotNull(), "pass").when(close, "flag").otherwise("skipped")
    return joined.select("document_id", "split", F.coalesce("exact", F.when(close, F.col("other"))).alias("parent"), verdict.alias("status"))


def chk_period_quantity(lines: DataFrame) -> DataFrame:
    """Rows (document_id, n_checked, n_wrong, status) of lines (document_id, quantity, n_due): as many months charged as are
    listed as due; lines that list none aren't checked."""
    due = (F.col("n_due") > 0) & F.col("quantity").isNotNull()
    wrong = due & (F.abs(F.col("quantity") - F.col("n_due")) >= SLACK)
    n = lines.groupBy("document_id").agg(F.count_if(due).alias("n_checked"), F.count_if(wrong).alias("n_wrong"))
    return n.withColumn("status", status(F.col("n_wrong") > 0, F.col("n_checked") > 0))


def chk_identifiers(printed: DataFrame) -> DataFrame:
    """Rows (document_id, n, n_bad, status) of printed identifiers (document_id, verdict), of which all should be valid."""
    n = printed.groupBy("document_id").agg(F.count("verdict").alias("n"), F.count_if(F.col("verdict") != "valid").alias("n_bad"))
    return n.withColumn("status", status(F.col("n_bad") > 0, F.col("n") > 0))


def reference_number(column: str) -> Column:
    """pass, flag or skipped (none is printed): letters and digits with hyphens, slashes, underscores, dots, blanks and
    number signs between them, of any length, at least one digit. No issuer's own form is asked for."""
    text = F.trim(F.col(column))
    good = text.rlike(r"^[A-Za-z0-9]([A-Za-z0-9/_. #-]*[A-Za-z0-9])?$") & text.rlike("[0-9]")
    return F.when(F.coalesce(text, F.lit("")) == "", "skipped").when(good, "pass").otherwise("flag")
