"""Registered reporting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import amounts
from dossier.operators import metadata, operations, reporting, risk, validation
from dossier.plans.catalogue import _CHECKS, _SCORE, _TIER, checks, register, rules
from dossier.plans.tables import cases, documents
from dossier.storage import read_table

REQUIRED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.risk_score(risk.rule_hits(checks(spark, sf_dir), rules(spark)), cases(spark, sf_dir).select("company_id", "case_id"))


@register(f"WITH {_CHECKS} SELECT document_id, sub_check, status, o_orderdate AS document_date, o_totalprice AS total_amount FROM checks JOIN orders ON o_orderkey = document_id WHERE status <> 'pass'")
def report_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reporting.report_exceptions(checks(spark, sf_dir), documents(spark, sf_dir))
    return found.select("document_id", "sub_check", "status", "document_date", "total_amount")


@register(
    f"""WITH {_CHECKS} SELECT sub_check, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'flag') AS n_flag, count(*) FILTER (WHERE status = 'skipped') AS n_skipped,
count(DISTINCT CASE WHEN status = 'flag' THEN case_id END) AS n_cases FROM checks GROUP BY 1"""
)
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.check_summary(checks(spark, sf_dir))


@register(f"WITH {_SCORE} SELECT case_id, unnest(range(1, len(string_split(reasons, ';')) + 1))::INTEGER AS line_no, unnest(string_split(reasons, ';')) AS rule_id FROM scores WHERE reasons <> ''")
def report_reason_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.reason_lines(scores(spark, sf_dir))


@register(
    f"""WITH want AS (SELECT unnest({REQUIRED}) AS t, unnest(range(5)) AS i), g AS (SELECT c_custkey, t, i FROM customer CROSS JOIN want),
m AS (SELECT c_custkey, t, i FROM g WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = t))
SELECT c.c_custkey AS case_id, count(t) = 0 AS complete, coalesce(string_agg(t, ',' ORDER BY i), '') AS pending FROM customer c LEFT JOIN m USING (c_custkey) GROUP BY 1"""
)
def pipeline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.pipeline_status(cases(spark, sf_dir), documents(spark, sf_dir), REQUIRED)


@register(
    f"""WITH {_SCORE}, p AS (SELECT o_custkey AS case_id, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1)
SELECT case_id, CASE WHEN coalesce(total, 0) = 0 THEN 'no_documents' WHEN finished < total THEN 'pipeline_incomplete' WHEN {_TIER} = 'high' THEN 'high_risk' END AS blocked_by FROM scores LEFT JOIN p USING (case_id)"""
)
def approval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.approval_gate(scores(spark, sf_dir), operations.document_progress(cases(spark, sf_dir), documents(spark, sf_dir)))


@register("SELECT o_custkey AS case_id, o_orderkey AS document_id, 'R' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS region_id FROM orders")
def region_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = operations.time_block(F.col("document_date"), 30 * 86400)
    return reporting.numbered(documents(spark, sf_dir), "case_id", "R", "document_date", "document_id", block=month).select("case_id", "document_id", "region_id")


@register("SELECT o_custkey AS case_id, o_orderkey AS document_id, o_totalprice AS total_amount FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest documents of each case."""
    return reporting.top_rows(documents(spark, sf_dir).select("case_id", "document_id", "total_amount"), "case_id", 3, F.desc("total_amount"), F.col("document_id"))


@register(
    """WITH n AS (SELECT o_custkey AS case_id, o_orderpriority AS document_type, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT case_id, document_type, n, sum(n) OVER (PARTITION BY case_id)::BIGINT AS n_group FROM n QUALIFY n < 0.25 * sum(n) OVER (PARTITION BY case_id)"""
)
def value_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.value_outliers(documents(spark, sf_dir), "case_id", "document_type")


@register("SELECT user_id, event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1, 2")
def page_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.group_median(read_table(spark, sf_dir, "events"), ["user_id", "event_type"], "value")


@register(
    """SELECT n_nationkey AS company_id, n_name AS company, count(o_orderkey) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00') AS in_period, count(o_orderkey) AS all_time
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"""
)
def usage_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("company"))
    used = documents(spark, sf_dir).join(cases(spark, sf_dir).select("company_id", "case_id"), "case_id").select("company_id", F.col("document_date").alias("used_at"))
    return reporting.usage_by_company(companies, used, "1997-01-01 00:00:00", "1998-01-01 00:00:00")


@register("SELECT c_nationkey AS company_id, count(*) AS n_users FROM customer GROUP BY 1")
def users_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("n_users"))


@register("SELECT o_orderkey AS document_id, o_custkey AS case_id, o_orderdate AS document_date FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00'")
def stuck_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = documents(spark, sf_dir).filter((F.col("status") != "F") & (F.col("document_date") < F.lit("2000-01-01 00:00:00").cast("timestamp")))
    return late.select("document_id", "case_id", "document_date")


@register("SELECT DISTINCT doc_id FROM labels WHERE doc_id IN (SELECT page_id FROM pages)")
def signal_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.signal_intersection(read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc_id"), ["doc_id"])


@register("SELECT doc_id FROM labels UNION SELECT page_id FROM pages")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.key_union(read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc_id"), ["doc_id"])


@register("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 500 OFFSET 1000")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the audit log, 500 rows a page, newest first."""
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), "event_id").offset(1000).limit(500)


@register(
    """WITH n AS (SELECT o_custkey AS case_id, o_orderstatus AS s FROM orders)
SELECT case_id, count(*) FILTER (WHERE s = 'F') AS "F", count(*) FILTER (WHERE s = 'O') AS "O", count(*) FILTER (WHERE s = 'P') AS "P" FROM n GROUP BY 1"""
)
def bulk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("case_id").pivot("status", ["F", "O", "P"]).count().fillna(0)


@register(f"WITH {_CHECKS} SELECT case_id, count(*) FILTER (WHERE status = 'flag' AND sub_check = 'line_items_sum') AS n_serious FROM checks GROUP BY 1 HAVING n_serious > 0")
def serious_undecided_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    serious = F.count_if((F.col("status") == "flag") & (F.col("sub_check") == "line_items_sum"))
    return checks(spark, sf_dir).groupBy("case_id").agg(serious.alias("n_serious")).filter("n_serious > 0")


@register(
    """SELECT o_orderkey AS document_id, CAST(floor(line_sum) AS BIGINT) AS amount,
CASE WHEN line_sum IS NULL THEN 'skipped' WHEN floor(line_sum) <> floor(o_totalprice) THEN 'flag' ELSE 'pass' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS line_sum FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def chk_amount_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of a document's lines, as printed in words, read and held against the document's total."""
    sums = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.floor(F.sum(F.col("l_extendedprice").cast("decimal(18,4)"))).cast("long").alias("sum"))
    printed = sums.select("document_id", F.concat(amounts.words_of_amount(F.col("sum")), F.lit(" dirhams only")).alias("printed"))
    read = documents(spark, sf_dir).join(printed, "document_id", "left").select("document_id", F.floor("total_amount").cast("long").alias("whole"), amounts.amount_in_words(F.col("printed")).alias("amount"))
    return read.select("document_id", F.col("amount").cast("long").alias("amount"), validation.status(F.col("amount") != F.col("whole"), F.col("amount").isNotNull()).alias("status"))


@register(
    """WITH f AS (SELECT o_orderkey AS document_id, o_orderpriority AS producer, o_orderdate AS created, o_orderstatus = 'F' AS lin, max(l_shipdate) AS modified, min(l_shipdate) AS xmp_modified, max(l_receipt) AS last_history, count(l_linenumber) AS sections
  FROM orders LEFT JOIN (SELECT *, l_shipdate AS l_receipt FROM lineitem) ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT *, epoch(modified) - epoch(created) AS gap, abs(epoch(modified) - epoch(xmp_modified)) AS xmp_gap, sections - CASE WHEN lin THEN 2 ELSE 1 END AS revisions FROM f)
SELECT document_id, 'info_xmp_mod_date_mismatch' AS finding, 'high' AS severity FROM r WHERE xmp_gap > 60
UNION ALL SELECT document_id, 'mod_date_after_creation_date', 'high' FROM r WHERE gap > 1
UNION ALL SELECT document_id, 'incremental_update_single', 'medium' FROM r WHERE revisions = 1
UNION ALL SELECT document_id, 'incremental_update_multiple', 'high' FROM r WHERE revisions > 1
UNION ALL SELECT document_id, 'history_absent_despite_revisions', 'medium' FROM r WHERE revisions > 0"""
)
def metadata_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: their lines are revisions, the first and last shipping dates the two modification dates."""
    li = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.max("l_shipdate").alias("modified"), F.min("l_shipdate").alias("xmp_modified"), F.count("*").alias("xref_sections"))
    none = lambda kind: F.lit(None).cast(kind)
    facts = documents(spark, sf_dir).join(li, "document_id", "left").select(
        "document_id",
        F.lit(True).alias("readable"),
        F.col("document_type").alias("producer"),
        none("string").alias("creator"),
        none("string").alias("xmp_producer"),
        F.col("document_date").alias("created"),
        "modified",
        none("timestamp").alias("xmp_created"),
        "xmp_modified",
        F.col("modified").alias("last_history"),
        F.lit(0).alias("n_history"),
        F.coalesce("xref_sections", F.lit(0)).alias("xref_sections"),
        (F.col("status") == "F").alias("is_linearized"),
        F.lit(0).alias("orphans"),
        F.lit(False).alias("risky_action"),
    )
    return metadata.metadata_findings(facts)


_REFERENCE = "CASE o_orderkey % 8 WHEN 0 THEN replace(o_orderpriority, ' ', '/') WHEN 1 THEN o_orderkey || '/' || o_custkey WHEN 2 THEN 'INV_' || o_orderkey || '.A #' || o_custkey WHEN 3 THEN o_orderkey || '-' WHEN 4 THEN '' WHEN 5 THEN o_orderpriority || '€' || o_orderkey WHEN 6 THEN repeat('A1-', 20) || o_orderkey END"


@register(
    f"""SELECT document_id, reference, CASE WHEN reference IS NULL OR trim(reference) = '' THEN 'skipped'
WHEN regexp_full_match(trim(reference), '[A-Za-z0-9]([A-Za-z0-9/_. #-]*[A-Za-z0-9])?') AND regexp_matches(reference, '[0-9]') THEN 'pass' ELSE 'flag' END AS status
FROM (SELECT o_orderkey AS document_id, {_REFERENCE} AS reference FROM orders)"""
)
def chk_reference_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed reference numbers of several shapes, made of the columns of a document."""
    printed = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.expr(_REFERENCE).alias("reference"))
    return printed.select("document_id", "reference", validation.reference_number("reference").alias("status"))
