"""Findings on a file's metadata, each a condition on one row of facts; all conditions are one array that is exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names in producer fields of programs that edit images or PDFs.
IMAGE_EDITORS = ("photoshop", "gimp", "illustrator", "affinity", "canva", "pixelmator", "paint.net")
PDF_EDITORS = ("ilovepdf", "smallpdf", "sejda", "pdfescape", "foxit phantompdf", "nitro", "pdf-xchange editor", "pdffiller")
WEB_ENGINES = ("skia/pdf", "chromium", "headlesschrome", "wkhtmltopdf", "firefox")


def _names(text: Column, names: tuple[str, ...]) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(n.replace(".", r"\.") for n in names))


def metadata_findings(facts: DataFrame) -> DataFrame:
    """Rows (document_id, finding, severity) of the facts (document_id, readable, producer, creator, xmp_producer, created,
    modified, xmp_created, xmp_modified, last_history, n_history, xref_sections, is_linearized, orphans, risky_action).

    A fact that is not known (null) gives no finding.
    """
    c = F.col
    seconds = lambda a, b: F.unix_timestamp(a) - F.unix_timestamp(b)
    tools = F.concat_ws(" ", "producer", "creator", "xmp_producer")
    revisions = c("xref_sections") - F.when(c("is_linearized"), 2).otherwise(1)
    rules = (
        ("pdf_unreadable", "high", ~c("readable")),
        ("metadata_entirely_stripped", "high", c("readable") & (F.trim(tools) == "") & F.coalesce("created", "modified", "xmp_created", "xmp_modified").isNull()),
        ("editing_software_detected", "high", _names(tools, IMAGE_EDITORS)),
        ("pdf_editor_detected", "medium", _names(tools, PDF_EDITORS)),
        ("web_page_origin", "low", _names(tools, WEB_ENGINES)),
        ("info_xmp_creation_date_mismatch", "high", F.abs(seconds("created", "xmp_created")) > 60),
        ("info_xmp_mod_date_mismatch", "high", F.abs(seconds("modified", "xmp_modified")) > 60),
        ("info_xmp_producer_mismatch", "medium", c("producer") != c("xmp_producer")),
        ("mod_date_after_creation_date", "high", seconds("modified", "created") > 1),
        ("incremental_update_single", "medium", revisions == 1),
        ("incremental_update_multiple", "high", revisions > 1),
        ("history_edit_after_final_date", "high", seconds("last_history", "modified") > 60),
        ("history_shorter_than_revisions", "medium", (c("n_history") > 0) & (c("n_history") < revisions)),
        ("history_absent_despite_revisions", "medium", (c("n_history") == 0) & (revisions > 0)),
        ("orphaned_objects", "medium", c("orphans") > 0),
        ("javascript_or_openaction", "medium", c("risky_action")),
    )
    found = F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("finding"), F.lit(severity).alias("severity"))) for name, severity, when in rules)))
    return facts.select("document_id", F.explode(found).alias("f")).select("document_id", "f.finding", "f.severity")


#: Actions of a file's history that change it, and what a scanner is called in it.
EDITS = "(?i)\\b(?:edited|modified|converted|derived|cropped|produced)\\b"
SCANS = "(?i)scan"


def _exploded(rows: DataFrame, rules: tuple[tuple[str, str, Column], ...]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("finding"), F.lit(severity).alias("severity"))) for name, severity, when in rules)))
    return rows.select("document_id", F.explode(found).alias("f")).select("document_id", "f.finding", "f.severity")


def history_findings(documents: DataFrame, history: DataFrame) -> DataFrame:
    """Rows (document_id, finding, severity) of the history (document_id, step, action, agent) of files (document_id, toolkit, producer,
    creator, xmp_producer, original_id, current_id, scanned).

    A history is info; an editing step in that of a scanned document (so marked, or whose history names a scan) is high,
    an editor of images or PDFs among its agents medium. producer_scrubbed: the toolkit is Adobe's, yet all producers are
    empty and there is no history. document_id_chain: the file descends from another. Steps are counted where they are,
    so a file of very many is no group."""
    edits = F.coalesce(F.col("action").rlike(EDITS), F.lit(False))
    agents = F.coalesce(F.col("agent"), F.lit(""))
    told = history.groupBy("document_id").agg(
        F.count("*").alias("steps"), F.bool_or(edits).alias("edited"), F.bool_or(F.coalesce(F.col("action").rlike(SCANS), F.lit(False)) | agents.rlike(SCANS)).alias("scan_step"), F.bool_or(_names(agents, IMAGE_EDITORS) | _names(agents, PDF_EDITORS)).alias("editor")
    )
    c = F.col
    rows = documents.join(told, "document_id", "left")
    steps = F.coalesce("steps", F.lit(0))
    scrubbed = c("toolkit").rlike("(?i)adobe xmp core") & (F.trim(F.concat_ws("", "producer", "creator", "xmp_producer")) == "") & (steps == 0)
    return _exploded(
        rows,
        (
            ("xmp_history", "info", steps > 0),
            ("history_scanned_document_edited", "high", c("edited") & (c("scan_step") | F.coalesce("scanned", F.lit(False)))),
            ("history_editing_tool_anomaly", "medium", c("editor")),
            ("producer_scrubbed", "medium", scrubbed),
            ("document_id_chain", "info", c("original_id") != c("current_id")),
        ),
    )


def page_findings(pages: DataFrame, page_cover: float = 0.9) -> DataFrame:
    """Rows (document_id, finding, severity) of the pages (document_id, page, image_share, visible_chars, layers, signatures) of files:
    editable_text_over_scan where an image of at least ``page_cover`` of a page lies under visible text, optional_content_groups
    and digital_signature where any page tells one."""
    over = (F.col("image_share") >= page_cover) & (F.col("visible_chars") > 0)
    told = pages.groupBy("document_id").agg(F.bool_or(over).alias("over"), F.sum("layers").alias("layers"), F.sum("signatures").alias("signatures"))
    return _exploded(told, (("editable_text_over_scan", "medium", F.col("over")), ("optional_content_groups", "low", F.col("layers") > 0), ("digital_signature", "info", F.col("signatures") > 0)))


def limited_pixel_check(results: DataFrame, pages: DataFrame, page_cover: float = 0.9) -> DataFrame:
    """``results`` (document_id, result, more) of the pixel check with result limited where a page of the file has text over a scan
    and the check passed: what was typed over an image leaves no trace in its pixels. limited_pages counts these pages."""
    over = pages.filter((F.col("image_share") >= page_cover) & (F.col("visible_chars") > 0)).groupBy("document_id").agg(F.countDistinct("page").alias("limited_pages"))
    joined = results.join(over, "document_id", "left").withColumn("limited_pages", F.coalesce("limited_pages", F.lit(0)))
    return joined.withColumn("result", F.when((F.col("limited_pages") > 0) & (F.col("result") == "pass"), "limited").otherwise(F.col("result")))
