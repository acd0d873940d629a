"""What is shown and kept: findings for a case's screen, private data, cases to be emptied, statuses and totals as printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Checks whose findings a case shows, and severities that matter.
FORENSIC = ("metadata_forensics", "error_level_analysis", "copy_move_detection", "duplicate_detection")
MATERIAL = ("medium", "high")
#: Fields of detected faces and signatures that no screen gets.
PRIVATE = ("embedding", "ink_template")


def flatten_forensic_findings(documents: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows (case_id, document_id, filename, check_type, finding, severity, description): every material finding of the completed and
    flagged forensic checks (document_id, check_type, status, result, findings: an array of structs) of the documents
    (case_id, document_id, filename). A null array has none; missing texts are empty."""
    kept = checks.filter(F.col("check_type").isin(*FORENSIC) & (F.col("status") == "completed") & (F.col("result") == "flag"))
    each = kept.select("document_id", "check_type", F.explode("findings").alias("f")).filter(F.col("f.severity").isin(*MATERIAL))
    text = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit("")).alias(c)
    return documents.join(each.select("document_id", "check_type", text("finding"), text("severity"), text("description")), "document_id").select("case_id", "document_id", "filename", "check_type", "finding", "severity", "description")


def strip_private_descriptors(items: Column, fields: list[str]) -> Column:
    """``items``, an array of structs of ``fields``, without those that are PRIVATE; null stays null."""
    gone = [f for f in fields if f in PRIVATE]
    return F.transform(items, lambda x: x.dropFields(*gone)) if gone else items


def private_cases_due(cases: DataFrame, documents: DataFrame, now: str, session_minutes: int, batch: int) -> DataFrame:
    """Rows (case_id, company_id, created): the ``batch`` oldest cases (case_id, company_id, private, created, removed) that are to be
    emptied: private ones whose session has ended, and emptied ones of which a document (case_id, file_deleted, has_text) is left.
    The limit is the feature; of equal ages the smaller id comes first."""
    left = documents.filter(F.col("file_deleted").isNull() | F.coalesce("has_text", F.lit(False))).select("case_id").distinct().withColumn("left", F.lit(True))
    ended = F.col("created") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(session_minutes)} MINUTES")
    due = cases.filter("private").join(left, "case_id", "left").filter((F.col("removed").isNull() & ended) | (F.col("removed").isNotNull() & F.coalesce("left", F.lit(False))))
    return due.select("case_id", "company_id", "created").orderBy("created", "case_id").limit(batch)


def printed_status(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (document_id, item_no, status) of the items (document_id, item_no, description, raw_total): paid or due as the first line
    (document_id, line_no, text) says that holds both its description and its total as printed, null if it says neither or both.

    Lines meet an item by the figures they hold: a total is looked up among a line's numbers, so no item meets every line.
    Descriptions of under four characters say too little."""
    number = r"(?<![0-9.,])[0-9][0-9.,]*[0-9]|(?<![0-9.,])[0-9]"
    figures = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({number})"), F.lit(1)))
    told = lines.select("document_id", "line_no", F.lower("text").alias("line"), F.explode(figures).alias("raw_total"))
    asked = items.filter((F.char_length(F.trim("description")) >= 4) & (F.trim("raw_total") != "")).select("document_id", "item_no", F.lower(F.trim("description")).alias("d"), F.trim("raw_total").alias("raw_total"))
    met = asked.join(told, ["document_id", "raw_total"]).filter(F.contains("line", F.col("d")))
    first = met.groupBy("document_id", "item_no").agg(F.min_by("line", "line_no").alias("line"))
    paid, due = F.col("line").rlike(r"\bpaid\b"), F.col("line").rlike(r"\bdue\b")
    status = F.when(paid & ~due, "paid").when(due & ~paid, "due")
    return items.select("document_id", "item_no").join(first, ["document_id", "item_no"], "left").select("document_id", "item_no", status.alias("status"))


def fill_core_fields(core: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (document_id, field, value, filled) of the core fields (document_id, field, value) and what tables say of them (document_id,
    field, value): empty fields, and fields that weren't there, take the table's value; none is overwritten. Of several
    table values of a field the smallest is taken."""
    told = totals.filter("value IS NOT NULL").groupBy("document_id", "field").agg(F.min("value").alias("told"))
    joined = core.join(told, ["document_id", "field"], "full")
    return joined.select("document_id", "field", F.coalesce("value", "told").alias("value"), (F.col("value").isNull() & F.col("told").isNotNull()).alias("filled"))
