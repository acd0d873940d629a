"""Reporting tables and per-group picks: what did not pass, which documents are missing, first and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def report_exceptions(sub_checks: DataFrame, documents: DataFrame) -> DataFrame:
    """Everything that did not pass, with its document."""
    return sub_checks.filter("status <> 'pass'").join(documents.select("document_id", "document_date", "total_amount"), "document_id")


def check_summary(sub_checks: DataFrame) -> DataFrame:
    """Rows (sub_check, n_pass, n_flag, n_skipped, n_cases): the headline of each check."""
    n = lambda s: F.count_if(F.col("status") == s)
    return sub_checks.groupBy("sub_check").agg(n("pass").alias("n_pass"), n("flag").alias("n_flag"), n("skipped").alias("n_skipped"), F.countDistinct(F.when(F.col("status") == "flag", F.col("case_id"))).alias("n_cases"))


def reason_lines(scores: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Rows (case_id, line_no, rule_id[, title]): one line for each fired rule, heaviest first, numbered from 1."""
    lines = scores.filter("reasons <> ''").select("case_id", F.posexplode(F.split("reasons", ";")).alias("p", "rule_id")).select("case_id", (F.col("p") + 1).alias("line_no"), "rule_id")
    return lines if titles is None else lines.join(titles, "rule_id", "left")


def pipeline_status(cases: DataFrame, documents: DataFrame, required: list[str]) -> DataFrame:
    """Rows (case_id, complete, pending): the required document types that a case lacks, in the given order.

    What a case has is a set of at most as many types as are required; no grid of cases and types is made.
    """
    wanted = F.array(*map(F.lit, required))
    have = documents.filter(F.col("document_type").isin(required)).groupBy("case_id").agg(F.collect_set("document_type").alias("have"))
    missing = F.array_except(wanted, F.coalesce("have", F.array().cast("array<string>")))
    return cases.select("case_id").join(have, "case_id", "left").select("case_id", (F.size(missing) == 0).alias("complete"), F.array_join(missing, ",").alias("pending"))


def approval_gate(scores: DataFrame, progress: DataFrame) -> DataFrame:
    """Rows (case_id, blocked_by): the first reason for which a case can't be approved, null if there is none."""
    joined = scores.join(progress, "case_id", "left")
    return joined.select("case_id", F.when(F.coalesce("total", F.lit(0)) == 0, "no_documents").when(F.col("finished") < F.col("total"), "pipeline_incomplete").when(F.col("tier") == "high", "high_risk").alias("blocked_by"))


def numbered(rows: DataFrame, group: str, prefix: str, *order: str, block: Column | None = None) -> DataFrame:
    """``rows`` with ``region_id``: R1, R2, ... within each group in the given order, which must tell rows apart.

    ``block``, which never falls in that order and is never null, cuts groups that may be very large: rows are numbered
    within a block, and those of the blocks before are added.
    """
    if block is None:
        return rows.withColumn("region_id", F.concat(F.lit(prefix), F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("string")))
    cut = rows.withColumn("__block", block)
    n = cut.groupBy(F.col(group).alias("__g"), F.col("__block").alias("__b")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__g").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begun = n.select("__g", "__b", before.alias("__before"))
    placed = cut.withColumn("__place", F.row_number().over(W.partitionBy(group, "__block").orderBy(*order)))
    joined = placed.join(begun, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b")))
    return joined.withColumn("region_id", F.concat(F.lit(prefix), (F.col("__before") + F.col("__place")).cast("string"))).select(*rows.columns, "region_id")


def top_rows(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("__place", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("__place") <= n).drop("__place")


def value_outliers(rows: DataFrame, group: str, value: str, share: float = 0.25) -> DataFrame:
    """Rows (group, value, n, n_group) of the values that a minority below ``share`` of a group has."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return n.withColumn("n_group", F.sum("n").over(W.partitionBy(group))).filter(F.col("n") < share * F.col("n_group"))


def group_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))


def usage_by_company(companies: DataFrame, usage: DataFrame, start: str, end: str) -> DataFrame:
    """Rows (company_id, in_period, all_time) with zeros for companies without usage; one pass over ``usage``."""
    inside = (F.col("used_at") >= F.lit(start).cast("timestamp")) & (F.col("used_at") < F.lit(end).cast("timestamp"))
    sums = usage.groupBy("company_id").agg(F.count_if(inside).alias("in_period"), F.count("*").alias("all_time"))
    return companies.join(sums, "company_id", "left").fillna(0, ["in_period", "all_time"])


def signal_intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")


def key_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).union(b.select(*keys)).distinct()


def report_check_rows(sub_checks: DataFrame, rules: DataFrame) -> DataFrame:
    """Every check of every document with its outcome and the weight of the heaviest rule that it fires, 0 for none."""
    heaviest = rules.filter("status = 'flag'").groupBy("sub_check").agg(F.max("weight").alias("weight"))
    joined = sub_checks.join(heaviest, "sub_check", "left")
    weight = F.when(F.col("status") == "flag", F.coalesce("weight", F.lit(0.0))).otherwise(0.0)
    return joined.select("company_id", "case_id", "document_id", F.col("sub_check").alias("check_type"), F.col("status").alias("outcome"), weight.alias("weight"))


def report_field_rows(documents: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows (keys, field, value): the fields (strings) of each document that have a value."""
    return documents.unpivot(keys, fields, "field", "value").filter("value IS NOT NULL")


def report_case(scores: DataFrame, documents: DataFrame, sub_checks: DataFrame) -> DataFrame:
    """One row for each case: score, tier and reasons, its documents and dates, and how its checks came out.

    Each section is one small row for a case before the joins, so that a case of any size is never one list.
    """
    held = documents.groupBy("case_id").agg(F.count("*").alias("n_documents"), F.min("document_date").alias("first_date"), F.max("document_date").alias("last_date"))
    n = lambda s: F.count_if(F.col("status") == s)
    found = sub_checks.groupBy("case_id").agg(n("flag").alias("n_flagged"), n("skipped").alias("n_skipped"))
    joined = scores.select("case_id", "score", "tier", "reasons").join(held, "case_id", "left").join(found, "case_id", "left")
    return joined.fillna(0, ["n_documents", "n_flagged", "n_skipped"])
