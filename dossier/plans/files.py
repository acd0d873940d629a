"""Queries of files: their histories and pages, and the invoices in them; orders are files and their lines steps, pages and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import invoices, metadata
from dossier.plans.catalogue import register
from dossier.storage import read_table

_STEP = "l_orderkey AS document_id, l_linenumber AS step, CASE l_partkey % 5 WHEN 0 THEN 'saved' WHEN 1 THEN 'edited' WHEN 2 THEN 'created' WHEN 3 THEN 'Converted to PDF' END AS action, CASE l_suppkey % 6 WHEN 0 THEN 'Adobe Photoshop 25' WHEN 1 THEN 'ScanJet' WHEN 2 THEN 'Smallpdf' WHEN 3 THEN NULL ELSE 'Writer' END AS agent"
_FILE = "o_orderkey AS document_id, CASE o_orderkey % 2 WHEN 0 THEN 'Adobe XMP Core 9.1' ELSE 'other' END AS toolkit, CASE WHEN o_custkey % 3 > 0 THEN 'Writer' END AS producer, CASE WHEN o_custkey % 9 = 0 THEN '' WHEN o_custkey % 4 = 0 THEN 'x' END AS creator, CAST(NULL AS STRING) AS xmp_producer, o_orderkey % 7 AS original_id, o_custkey % 7 AS current_id, o_orderstatus = 'F' AS scanned"


@register(
    f"""WITH h AS (SELECT {_STEP} FROM lineitem WHERE l_returnflag = 'A'), f AS (SELECT {_FILE.replace("STRING", "VARCHAR")} FROM orders),
t AS (SELECT document_id, count(*) AS steps, bool_or(coalesce(action IN ('edited', 'Converted to PDF'), false)) AS edited, bool_or(coalesce(agent = 'ScanJet', false)) AS scan_step, bool_or(coalesce(agent IN ('Adobe Photoshop 25', 'Smallpdf'), false)) AS editor FROM h GROUP BY 1),
r AS (SELECT * FROM f LEFT JOIN t USING (document_id))
SELECT document_id, 'xmp_history' AS finding, 'info' AS severity FROM r WHERE steps > 0 UNION ALL SELECT document_id, 'history_scanned_document_edited', 'high' FROM r WHERE edited AND (scan_step OR scanned)
UNION ALL SELECT document_id, 'history_editing_tool_anomaly', 'medium' FROM r WHERE editor UNION ALL SELECT document_id, 'producer_scrubbed', 'medium' FROM r WHERE toolkit LIKE 'Adobe%' AND coalesce(producer, '') || coalesce(creator, '') = '' AND steps IS NULL
UNION ALL SELECT document_id, 'document_id_chain', 'info' FROM r WHERE original_id <> current_id"""
)
def history_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = read_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").selectExpr(*_split(_STEP))
    return metadata.history_findings(read_table(spark, sf_dir, "orders").selectExpr(*_split(_FILE)), steps)


def _split(columns: str) -> list[str]:
    """The expressions of a select list: cut at commas outside of brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]


_PAGE = "l_orderkey AS document_id, l_linenumber AS page, l_quantity / 50 AS image_share, l_partkey % 4 AS visible_chars, CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END AS layers, CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END AS signatures"


@register(
    f"""WITH p AS (SELECT {_PAGE} FROM lineitem), t AS (SELECT document_id, bool_or(image_share >= 0.9::DOUBLE AND visible_chars > 0) AS over, sum(layers) AS layers, sum(signatures) AS signatures FROM p GROUP BY 1)
SELECT document_id, 'editable_text_over_scan' AS finding, 'medium' AS severity FROM t WHERE over UNION ALL SELECT document_id, 'optional_content_groups', 'low' FROM t WHERE layers > 0 UNION ALL SELECT document_id, 'digital_signature', 'info' FROM t WHERE signatures > 0"""
)
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.page_findings(read_table(spark, sf_dir, "lineitem").selectExpr(*_split(_PAGE)))


@register(
    f"""WITH p AS (SELECT {_PAGE} FROM lineitem), o AS (SELECT document_id, count(DISTINCT page) AS n FROM p WHERE image_share >= 0.9::DOUBLE AND visible_chars > 0 GROUP BY 1)
SELECT o_orderkey AS document_id, CASE WHEN n > 0 AND o_orderstatus <> 'F' THEN 'limited' WHEN o_orderstatus = 'F' THEN 'flag' ELSE 'pass' END AS result, coalesce(n, 0) AS limited_pages FROM orders LEFT JOIN o ON document_id = o_orderkey"""
)
def limited_pixel_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "flag").otherwise("pass").alias("result"))
    return metadata.limited_pixel_check(results, read_table(spark, sf_dir, "lineitem").selectExpr(*_split(_PAGE)))


_FACTS = """o_orderkey AS document_id, o_orderkey % 23 > 0 AS readable, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'GIMP 2.10' WHEN 2 THEN 'iLovePDF' WHEN 3 THEN 'Skia/PDF m1' ELSE 'Writer' END AS producer, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE '' END AS creator,
CASE o_custkey % 4 WHEN 0 THEN 'Writer' WHEN 1 THEN 'GIMP 2.10' END AS xmp_producer, CASE WHEN o_custkey % 3 > 0 THEN o_orderdate END AS created, CASE WHEN o_custkey % 5 > 0 THEN o_orderdate + INTERVAL '1' DAY * ((o_custkey % 4) - 1) END AS modified,
CASE WHEN o_custkey % 3 = 2 THEN o_orderdate + INTERVAL '1' MINUTE * (o_orderkey % 3) END AS xmp_created, CASE WHEN o_custkey % 7 = 2 THEN o_orderdate + INTERVAL '1' DAY END AS xmp_modified, CASE WHEN o_custkey % 2 = 0 THEN o_orderdate + INTERVAL '1' DAY END AS last_history,
CAST(o_custkey % 3 AS INT) AS n_history, CAST(o_orderkey % 4 + 1 AS INT) AS xref_sections, o_orderkey % 3 = 0 AS is_linearized, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END AS orphans, CASE WHEN o_orderkey % 13 = 0 THEN true WHEN o_orderkey % 13 = 1 THEN NULL ELSE false END AS risky_action"""


@register(
    f"""WITH f AS (SELECT {_FACTS} FROM orders), r AS (SELECT *, xref_sections - CASE WHEN is_linearized THEN 2 ELSE 1 END AS rev, lower(concat_ws(' ', producer, creator, xmp_producer)) AS tools FROM f),
w AS (SELECT document_id, unnest([NOT readable, readable AND trim(tools) = '' AND coalesce(created, modified, xmp_created, xmp_modified) IS NULL, contains(tools, 'gimp'), contains(tools, 'ilovepdf'), contains(tools, 'skia/pdf'), abs(epoch(created) - epoch(xmp_created)) > 60, abs(epoch(modified) - epoch(xmp_modified)) > 60, producer <> xmp_producer,
  epoch(modified) - epoch(created) > 1, rev = 1, rev > 1, epoch(last_history) - epoch(modified) > 60, n_history > 0 AND n_history < rev, n_history = 0 AND rev > 0, orphans > 0, risky_action]) AS hit,
  unnest(['pdf_unreadable', 'metadata_entirely_stripped', 'editing_software_detected', 'pdf_editor_detected', 'web_page_origin', 'info_xmp_creation_date_mismatch', 'info_xmp_mod_date_mismatch', 'info_xmp_producer_mismatch', 'mod_date_after_creation_date', 'incremental_update_single', 'incremental_update_multiple',
  'history_edit_after_final_date', 'history_shorter_than_revisions', 'history_absent_despite_revisions', 'orphaned_objects', 'javascript_or_openaction']) AS finding,
  unnest(['high', 'high', 'high', 'medium', 'low', 'high', 'high', 'medium', 'high', 'medium', 'high', 'high', 'medium', 'medium', 'medium', 'medium']) AS severity FROM r)
SELECT document_id, finding, severity FROM w WHERE hit"""
)
def metadata_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of files dealt from columns that disagree, so that every rule has files that it tells and files that it doesn't."""
    return metadata.metadata_findings(read_table(spark, sf_dir, "orders").selectExpr(*_split(_FACTS)))


_ITEMS = "l_orderkey AS document_id, l_extendedprice AS total, CASE WHEN l_partkey % 9 > 0 THEN floor(l_extendedprice * l_tax * 100) / 100 END AS vat"


@register(
    f"""WITH i AS (SELECT {_ITEMS} FROM lineitem), e AS (SELECT document_id, 'total' AS role, total AS amount FROM i UNION ALL SELECT document_id, 'vat', vat FROM i WHERE vat IS NOT NULL),
s AS (SELECT document_id, role, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS column_sum, count(*) AS n FROM e GROUP BY 1, 2),
p AS (SELECT document_id, role, CASE WHEN document_id % 4 = 0 THEN NULL WHEN document_id % 4 = 1 THEN round(column_sum, 2) + 5 ELSE round(column_sum, 2) END AS printed FROM s WHERE document_id % 4 > 0)
SELECT s.document_id, s.role, round(column_sum, 4) AS column_sum, round(printed, 4) AS printed, n, CASE WHEN printed IS NULL THEN 'skipped' WHEN abs(column_sum - printed) > 0.01::DOUBLE * n + 1e-9 THEN 'flag' ELSE 'pass' END AS status FROM s LEFT JOIN p USING (document_id, role)"""
)
def multi_column_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of totals and taxes of an order's lines; every fourth order prints no totals, another fourth wrong ones."""
    items = read_table(spark, sf_dir, "lineitem").selectExpr(*_split(_ITEMS)).select("document_id", F.create_map(F.lit("total"), F.col("total"), F.lit("vat"), F.col("vat")).alias("columns"))
    sums = invoices.multi_column_sums(items, spark.createDataFrame([], "document_id long, role string, value double"))
    totals = sums.filter("document_id % 4 > 0").select("document_id", "role", (F.round("column_sum", 2) + F.when(F.col("document_id") % 4 == 1, 5).otherwise(0)).alias("value"))
    found = invoices.multi_column_sums(items, totals)
    return found.withColumns({c: F.round(c, 4) for c in ("column_sum", "printed")})


_INVOICES = "l_orderkey AS document_id, l_suppkey % 3 AS invoice_no"


@register(
    f"""WITH l AS (SELECT {_INVOICES}, l_quantity AS quantity, CASE WHEN l_partkey % 10 = 0 THEN 1.0 ELSE l_extendedprice / l_quantity END AS unit_price, l_extendedprice AS total FROM lineitem),
s AS (SELECT document_id, invoice_no, sum(CASE WHEN abs(quantity * unit_price - total) > 0.02 + 0.005 * quantity + 1e-9 THEN 1 ELSE 0 END) AS wrong, count(*) AS n, CAST(sum(CAST(total AS DECIMAL(18,4))) AS DOUBLE) AS sum FROM l GROUP BY 1, 2),
v AS (SELECT *, round(sum, 2) + CASE WHEN document_id % 5 = 0 AND invoice_no = 1 THEN 3 ELSE 0 END AS subtotal FROM s), w AS (SELECT *, round(subtotal * 0.05::DOUBLE, 2) AS tax FROM v),
p AS (SELECT *, subtotal + tax + CASE WHEN document_id % 7 = 0 THEN 1 ELSE 0 END AS t FROM w),
c AS (SELECT document_id, unnest(['line_item_arithmetic', 'subtotal_line_item_consistency', 'total_tax_consistency', 'tax_rate_consistency']) AS k, unnest([wrong > 0, abs(sum - subtotal) > 0.01::DOUBLE * n + 1e-9, abs(subtotal + tax - t) > 0.02::DOUBLE + 1e-9, abs(subtotal * (CASE WHEN document_id % 11 = 0 THEN 6 ELSE 5 END)::DOUBLE / 100 - tax) > 0.01::DOUBLE + 1e-9]) AS hit FROM p),
f AS (SELECT document_id, sum(CASE WHEN hit AND NOT (k = 'total_tax_consistency' AND document_id % 14 = 0) THEN 1 ELSE 0 END)::BIGINT AS problems, sum(CASE WHEN hit AND k = 'total_tax_consistency' AND document_id % 14 = 0 THEN 1 ELSE 0 END)::BIGINT AS repeats FROM c GROUP BY 1)
SELECT document_id, m AS invoices, CASE WHEN m < 2 THEN 0 ELSE problems END AS problems, CASE WHEN m < 2 THEN 0 ELSE repeats END AS repeats, CASE WHEN m < 2 THEN 'skipped' WHEN problems > 0 THEN 'flag' ELSE 'pass' END AS status FROM f JOIN (SELECT document_id, count(*) AS m FROM s GROUP BY 1) USING (document_id)"""
)
def chk_per_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order by supplier are up to three invoices of a file, with totals some of which are wrong."""
    price = F.when(F.col("l_partkey") % 10 == 0, 1.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_suppkey") % 3).alias("invoice_no"), F.col("l_quantity").alias("quantity"), price.alias("unit_price"), F.col("l_extendedprice").alias("total"))
    sums = lines.groupBy("document_id", "invoice_no").agg(F.sum(F.col("total").cast("decimal(18,4)")).cast("double").alias("sum"))
    k = F.col("document_id")
    subtotal = F.round("sum", 2) + F.when((k % 5 == 0) & (F.col("invoice_no") == 1), 3).otherwise(0)
    told = sums.withColumn("subtotal", subtotal).withColumn("tax", F.round(F.col("subtotal") * 0.05, 2)).withColumn("total", F.col("subtotal") + F.col("tax") + F.when(k % 7 == 0, 1).otherwise(0)).withColumn("rate", F.when(k % 11 == 0, 6.0).otherwise(5.0)).drop("sum")
    known = told.filter("document_id % 14 = 0").select("document_id", F.lit("total_tax_consistency").alias("sub_check"))
    return invoices.per_invoice(told, lines, known)


@register(
    """WITH l AS (SELECT DISTINCT l_orderkey AS document_id, l_suppkey % 3 AS invoice_no, l_linenumber AS page FROM lineitem), f AS (SELECT document_id, page, min(invoice_no) AS invoice_no FROM l GROUP BY 1, 2)
SELECT o_orderkey AS document_id, CAST(o_custkey % 8 AS INT) AS page, invoice_no FROM orders LEFT JOIN f ON f.document_id = o_orderkey AND f.page = o_custkey % 8"""
)
def invoice_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), (F.col("l_suppkey") % 3).alias("invoice_no")).agg(F.collect_set(F.col("l_linenumber").cast("int")).alias("pages"))
    asked = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 8).cast("int").alias("page"))
    return invoices.invoice_on_page(li, asked)
