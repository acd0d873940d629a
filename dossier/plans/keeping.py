"""Queries of what is shown and kept: lines are findings, items and figures of orders, customers are cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import keeping
from dossier.plans.catalogue import register
from dossier.storage import read_table

_TYPE = "CASE l_partkey % 6 WHEN 0 THEN 'metadata_forensics' WHEN 1 THEN 'error_level_analysis' WHEN 2 THEN 'copy_move_detection' WHEN 3 THEN 'duplicate_detection' ELSE 'field_validation' END"


@register(
    f"""SELECT o_custkey AS case_id, l_orderkey AS document_id, o_orderpriority AS filename, {_TYPE} AS check_type, l_returnflag AS finding, CASE l_linenumber % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' END AS severity, CASE WHEN l_suppkey % 2 = 0 THEN 'd' ELSE '' END AS description
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 6 < 4 AND l_linestatus = 'F' AND l_returnflag <> 'N' AND l_linenumber % 3 < 2"""
)
def flatten_forensic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'low' END")
    finding = F.struct(F.col("l_returnflag").alias("finding"), severity.alias("severity"), F.when(F.col("l_suppkey") % 2 == 0, "d").alias("description"))
    checks = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.expr(_TYPE).alias("check_type"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("running").alias("status"), F.when(F.col("l_returnflag") == "N", "pass").otherwise("flag").alias("result"), F.array(finding).alias("findings"))
    documents = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("filename"))
    return keeping.flatten_forensic_findings(documents, checks)


@register("SELECT vec_id, label, count(*) AS n_fields FROM embeddings GROUP BY 1, 2")
def strip_private_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as descriptors of faces beside their label: what is left of an item is one field."""
    items = read_table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.struct("label", "embedding")).alias("faces"))
    public = items.select("vec_id", F.explode(keeping.strip_private_descriptors(F.col("faces"), ["label", "embedding"])).alias("face"))
    n = len(public.schema["face"].dataType.fieldNames())
    return public.select("vec_id", "face.label", F.lit(n).cast("long").alias("n_fields"))


@register(
    """WITH c AS (SELECT c_custkey AS case_id, c_nationkey AS company_id, min(o_orderdate) AS created, CASE WHEN c_custkey % 3 = 0 THEN max(o_orderdate) END AS removed, bool_or(o_orderstatus <> 'F' OR o_orderkey % 5 = 0) AS left_over FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 GROUP BY c_custkey, c_nationkey)
SELECT case_id, company_id, created FROM c WHERE (removed IS NULL AND created < TIMESTAMP '1997-01-01 00:00:00') OR (removed IS NOT NULL AND left_over) ORDER BY created, case_id LIMIT 100"""
)
def private_cases_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    times = o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.min("o_orderdate").alias("created"), F.max("o_orderdate").alias("last"))
    cases = c.select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("company_id"), (F.col("c_custkey") % 2 == 0).alias("private")).join(times, "case_id")
    cases = cases.withColumn("removed", F.when(F.col("case_id") % 3 == 0, F.col("last"))).drop("last")
    documents = o.select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("file_deleted"), (F.col("o_orderkey") % 5 == 0).alias("has_text"))
    return keeping.private_cases_due(cases, documents, "1997-01-01 01:00:00", 60, 100)


_LINE = "concat(CASE l_partkey % 3 WHEN 0 THEN 'Books and more' WHEN 1 THEN 'FEES' ELSE 'Bus' END, ' ', CAST(l_suppkey AS STRING), ': ', CAST(CAST(floor(l_quantity) AS INT) AS STRING), CASE l_linenumber % 4 WHEN 0 THEN ' PAID' WHEN 1 THEN ' due' WHEN 2 THEN ' paid, due' ELSE '' END)"
_NO = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"


@register(
    f"""WITH l AS (SELECT l_orderkey AS document_id, {_NO} AS no, {_LINE.replace("STRING", "VARCHAR")} AS text, CASE l_partkey % 3 WHEN 0 THEN 'books AND more' WHEN 1 THEN 'Fees' ELSE 'Bus' END AS description, CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR) AS raw FROM lineitem),
m AS (SELECT a.document_id, a.no, arg_min(lower(b.text), b.no) AS line FROM l a JOIN l b ON a.document_id = b.document_id AND length(a.description) >= 4 AND contains(lower(b.text), lower(a.description)) AND regexp_matches(b.text, '(^|[^0-9.,])' || a.raw || '($|[^0-9.,])') GROUP BY 1, 2)
SELECT l.document_id, CAST(l.no AS INT) AS item_no, CASE WHEN regexp_matches(line, '\\bpaid\\b') AND NOT regexp_matches(line, '\\bdue\\b') THEN 'paid' WHEN regexp_matches(line, '\\bdue\\b') AND NOT regexp_matches(line, '\\bpaid\\b') THEN 'due' END AS status FROM l LEFT JOIN m USING (document_id, no)"""
)
def printed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as printed lines and as items; an item's figure may stand on lines of others first."""
    read_table(spark, sf_dir, "lineitem").createOrReplaceTempView("keeping_lines")
    rows = spark.sql(f"SELECT l_orderkey AS document_id, {_NO} AS no, {_LINE} AS text, CASE l_partkey % 3 WHEN 0 THEN 'books AND more' WHEN 1 THEN 'Fees' ELSE 'Bus' END AS description, CAST(CAST(floor(l_quantity) AS INT) AS STRING) AS raw_total FROM keeping_lines")
    return keeping.printed_status(rows.select("document_id", F.col("no").alias("item_no"), "description", "raw_total"), rows.select("document_id", F.col("no").alias("line_no"), "text"))


@register(
    """WITH t AS (SELECT l_orderkey AS document_id, CASE WHEN l_returnflag = 'A' THEN 'amount' ELSE 'tax_amount' END AS field, min(l_extendedprice) AS told FROM lineitem GROUP BY 1, 2),
c AS (SELECT o_orderkey AS document_id, 'amount' AS field, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS value FROM orders)
SELECT coalesce(c.document_id, t.document_id) AS document_id, coalesce(c.field, t.field) AS field, coalesce(value, told) AS value, value IS NULL AND told IS NOT NULL AS filled FROM c FULL JOIN t ON c.document_id = t.document_id AND c.field = t.field"""
)
def fill_core_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit("amount").alias("field"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("value"))
    told = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "A", "amount").otherwise("tax_amount").alias("field"), F.col("l_extendedprice").alias("value"))
    return keeping.fill_core_fields(core, told)
