"""Rule evaluation and risk scores: rules are data, evidence is a table, a score is an aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEDIUM, HIGH, METADATA_CAP = 30, 60, 40


def rule_current(rules: DataFrame) -> DataFrame:
    """The newest version of each (company_id, rule_id); an inactive newest version hides older active ones."""
    newest = rules.groupBy("company_id", "rule_id").agg(F.max_by(F.struct(*rules.columns), "version").alias("newest"))
    return newest.select(*(F.col("newest").getField(c).alias(c) for c in rules.columns)).filter("is_active")


def rule_hits(sub_checks: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (company_id, case_id, rule_id, weight, n_documents): active rules (rule_id, sub_check, status, weight) that
    the sub-checks (company_id, case_id, document_id, sub_check, status) fire."""
    fired = sub_checks.join(rules, ["sub_check", "status"])
    return fired.groupBy("company_id", "case_id", "rule_id", "weight").agg(F.countDistinct("document_id").alias("n_documents"))


def unmatched_findings(sub_checks: DataFrame, rules: DataFrame) -> DataFrame:
    """Flagged sub-checks that no rule, active or not, speaks of."""
    return sub_checks.filter("status = 'flag'").join(rules.select("sub_check").distinct(), "sub_check", "left_anti")


def tier_of(score: Column, medium: Column, high: Column) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def risk_score(hits: DataFrame, cases: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Rows (company_id, case_id, raw_score, score, tier, reasons), one for each case (company_id, case_id).

    Weights of ``metadata.`` rules are capped together; the score is the half-even rounded sum within 0 and 100.
    Settings (company_id, medium_threshold, high_threshold, metadata_score_cap) default where a company has none.
    Reasons are the fired rules by weight, heaviest first, then by name.
    """
    meta = F.col("rule_id").startswith("metadata.")
    sums = hits.groupBy("company_id", "case_id").agg(
        F.sum(F.when(meta, 0.0).otherwise(F.col("weight"))).alias("plain"),
        F.sum(F.when(meta, F.col("weight")).otherwise(0.0)).alias("capped"),
        F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "rule_id"))).alias("fired"),  # at most one for each rule
    )
    found = cases.join(sums, ["company_id", "case_id"], "left")
    if settings is None:
        limits = {"medium_threshold": F.lit(MEDIUM), "high_threshold": F.lit(HIGH), "metadata_score_cap": F.lit(METADATA_CAP)}
    else:
        found = found.join(settings, "company_id", "left")
        limits = {c: F.coalesce(F.col(c), F.lit(d)) for c, d in (("medium_threshold", MEDIUM), ("high_threshold", HIGH), ("metadata_score_cap", METADATA_CAP))}
    raw = F.coalesce("plain", F.lit(0.0)) + F.least(F.coalesce("capped", F.lit(0.0)), limits["metadata_score_cap"].cast("double"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw, 0).cast("int")))
    reasons = F.array_join(F.transform(F.coalesce("fired", F.array().cast("array<struct<w:double,rule_id:string>>")), lambda x: x["rule_id"]), ";")
    return found.select("company_id", "case_id", raw.alias("raw_score"), score.alias("score"), tier_of(score, limits["medium_threshold"], limits["high_threshold"]).alias("tier"), reasons.alias("reasons"))


def evidence_fingerprint(hits: DataFrame) -> DataFrame:
    """Rows (case_id, fingerprint): one hash of the sorted fired rules and their document counts of each case."""
    parts = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "rule_id", F.col("n_documents").cast("string")))), ",")
    return hits.groupBy("case_id").agg(F.sha2(parts, 256).alias("fingerprint"))


def append_assessment(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose (case_id, fingerprint) is not stored yet."""
    return new.join(stored.select("case_id", "fingerprint"), ["case_id", "fingerprint"], "left_anti")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of ``order``, which must tell all rows of a key apart."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("last_row"))
    return last.select(*(F.col("last_row").getField(c).alias(c) for c in rows.columns))


def case_flags(cases: DataFrame, assessments: DataFrame, top: int = 3) -> DataFrame:
    """Rows (case_id, tier, flags): the first ``top`` distinct reasons and "+N more"; pending without an assessment."""
    joined = cases.select("case_id").join(assessments.select("case_id", "tier", "reasons"), "case_id", "left")
    titles = F.array_distinct(F.filter(F.split(F.coalesce("reasons", F.lit("")), ";"), lambda x: x != ""))
    more = F.greatest(F.size(titles) - top, F.lit(0))
    shown = F.concat_ws(", ", F.slice(titles, 1, top), F.when(more > 0, F.concat(F.lit("+"), more.cast("string"), F.lit(" more"))))
    return joined.select("case_id", F.coalesce("tier", F.lit("pending")).alias("tier"), shown.alias("flags"))


def quick_risk(findings: DataFrame) -> DataFrame:
    """Severity points 45 / 35 / 20 / 10 and 5 for a harmless one, at most 100, per case."""
    points = F.when(F.col("severity") == "critical", 45).when(F.col("severity") == "high", 35).when(F.col("severity") == "medium", 20).when(F.col("severity") == "low", 10).otherwise(5)
    return findings.groupBy("case_id").agg(F.least(F.lit(100), F.sum(points)).cast("long").alias("points"))
