"""Registered queries of evidence, rules of five kinds, case access and the streams that ask for scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import access, evidence, identity, reporting, risk
from dossier.plans.catalogue import _CHECKS, _RULE_VALUES, _SCORE, _TIER, RULE_COLUMNS, checks, register, rules
from dossier.plans.more import streamed, streamed_documents
from dossier.plans.reports import scores
from dossier.plans.tables import cases, documents
from dossier.sources import records
from dossier.storage import read_table
from dossier.streaming import monitor

#: Rules as data: rule, kind, check type (null: any), names and severities (null: any), weight, active.
KIND_RULES = (
    ("finding.returned", "finding", "metadata", ("R",), None, 20.0, True),
    ("finding.severe", "finding", None, None, ("high",), 10.0, True),
    ("finding.off", "finding", "metadata", ("A",), ("medium",), 15.0, False),
    ("field.arithmetic", "sub_check", "field_validation", ("line_item_arithmetic",), None, 25.0, True),
    ("field.dates", "sub_check", "field_validation", ("date_in_future", "date_sequence"), None, 15.0, True),
    ("issuer.unknown", "check_result", "issuer", ("O",), None, 5.0, True),
    ("identity.balance", "cross_document", None, ("balance",), ("critical", "high"), 40.0, True),
    ("identity.signature", "signature_match", None, ("1-URGENT",), None, 35.0, True),
)


def _array(values: tuple[str, ...] | None) -> str:
    return "NULL" if values is None else f"array({', '.join(repr(v) for v in values)})"


def kind_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{r}', '{k}', {'NULL' if c is None else repr(c)}, {_array(n)}, {_array(s)}, {w}D, {str(a).lower()})" for r, k, c, n, s, w, a in KIND_RULES)
    columns = "rule_id, kind, check_type, names, severities, weight, is_active"
    return spark.sql(f"SELECT rule_id, kind, cast(check_type AS STRING) AS check_type, cast(names AS ARRAY<STRING>) AS names, cast(severities AS ARRAY<STRING>) AS severities, weight, is_active FROM VALUES {rows} AS r({columns})")


def owned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(cases(spark, sf_dir).select("company_id", "case_id"), "case_id")


def case_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as findings, field checks, order states as results of a check, debts as conflicts, urgent orders as signatures."""
    docs, li, c = owned_documents(spark, sf_dir), read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "customer")
    severity = F.when(F.col("l_quantity") > 45, "high").when(F.col("l_quantity") > 25, "medium").otherwise("low")
    return evidence.gather_evidence(
        docs,
        finding=li.select(F.col("l_orderkey").alias("document_id"), F.lit("metadata").alias("check_type"), F.col("l_returnflag").alias("name"), severity.alias("severity"), F.col("l_linenumber").alias("idx"), F.col("l_linestatus").alias("note")),
        sub_check=checks(spark, sf_dir).select("document_id", F.lit("field_validation").alias("check_type"), F.col("sub_check").alias("name"), F.col("status").alias("severity")),
        check_result=docs.select("document_id", F.lit("issuer").alias("check_type"), F.col("status").alias("name")),
        cross_document=c.filter("c_acctbal < 0").select(
            F.col("c_nationkey").alias("company_id"), F.col("c_custkey").alias("case_id"), F.lit("balance").alias("name"), F.when(F.col("c_acctbal") < -500, "critical").otherwise("medium").alias("severity"),
            F.lit("conflict").alias("classification"), F.when(F.col("c_mktsegment") == "BUILDING", "dismissed").otherwise("pending").alias("review_status"),
        ),
        signature_match=docs.select("document_id", F.col("document_type").alias("name")),
    )


_EVIDENCE = f"""{_CHECKS}, docs AS (SELECT c_nationkey AS company_id, c_custkey AS case_id, o_orderkey AS document_id, o_orderstatus, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey),
evidence AS (
  SELECT company_id, case_id, document_id, 'finding' AS kind, 'metadata' AS check_type, l_returnflag AS name, CASE WHEN l_quantity > 45 THEN 'high' WHEN l_quantity > 25 THEN 'medium' ELSE 'low' END AS severity, l_linenumber AS idx, l_linestatus AS note
  FROM lineitem JOIN docs ON document_id = l_orderkey
  UNION ALL SELECT company_id, case_id, document_id, 'sub_check', 'field_validation', sub_check, status, NULL, NULL FROM checks JOIN (SELECT document_id FROM docs) USING (document_id) WHERE status = 'flag'
  UNION ALL SELECT company_id, case_id, document_id, 'check_result', 'issuer', o_orderstatus, NULL, NULL, NULL FROM docs
  UNION ALL SELECT c_nationkey, c_custkey, NULL, 'cross_document', NULL, 'balance', CASE WHEN c_acctbal < -500 THEN 'critical' ELSE 'medium' END, NULL, NULL FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING'
  UNION ALL SELECT company_id, case_id, document_id, 'signature_match', NULL, o_orderpriority, NULL, NULL, NULL FROM docs
)"""


def _sql_rules() -> str:
    rows = []
    for r, k, c, n, s, w, a in KIND_RULES:
        tests = [f"kind = '{k}'"] + ([f"check_type = '{c}'"] if c else [])
        tests += [f"{column} IN ({', '.join(repr(v) for v in values)})" for column, values in (("name", n), ("severity", s)) if values]
        rows.append(f"SELECT company_id, case_id, document_id, '{r}' AS rule_id, {w}::DOUBLE AS weight, {str(a).lower()} AS is_active, coalesce(idx, 0) AS idx, note FROM evidence WHERE {' AND '.join(tests)}")
    return " UNION ALL ".join(rows)


_KIND_HITS = f"{_EVIDENCE}, matched AS ({_sql_rules()}), doc_hits AS (SELECT company_id, case_id, rule_id, weight, is_active, document_id, count(*) AS n, arg_min(note, struct_pack(i := idx, n := coalesce(note, ''))) AS first_note FROM matched GROUP BY ALL)"


@register(f"WITH {_EVIDENCE} SELECT kind, check_type, name, severity, count(*) AS n, count(DISTINCT case_id) AS n_cases, count(DISTINCT document_id) AS n_documents FROM evidence GROUP BY ALL")
def gather_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is of each kind of evidence."""
    found = case_evidence(spark, sf_dir).groupBy("kind", "check_type", "name", "severity")
    return found.agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("n_cases"), F.countDistinct("document_id").alias("n_documents"))


@register(f"WITH {_KIND_HITS} SELECT company_id, case_id, rule_id, weight, is_active, document_id, n FROM doc_hits")
def rule_hits_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = evidence.hits_by_document(case_evidence(spark, sf_dir), kind_rules(spark))
    return hits.drop("first_note")


@register(f"WITH {_KIND_HITS} SELECT case_id, document_id, rule_id, first_note FROM doc_hits WHERE rule_id LIKE 'finding.%' AND first_note IS NOT NULL")
def first_match_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first matching finding of each rule and document says."""
    hits = evidence.hits_by_document(case_evidence(spark, sf_dir).filter("kind = 'finding'"), kind_rules(spark))
    return hits.filter("first_note IS NOT NULL").select("case_id", "document_id", "rule_id", "first_note")


@register(
    f"""WITH {_KIND_HITS}, per AS (SELECT company_id, case_id, rule_id, weight, greatest(count(DISTINCT document_id), 1) AS n FROM doc_hits WHERE is_active GROUP BY ALL),
s AS (SELECT case_id, sum(weight) AS raw, string_agg(rule_id, ';' ORDER BY weight DESC, rule_id) AS reasons FROM per GROUP BY 1),
t AS (SELECT c_nationkey AS company_id, c_custkey AS case_id, coalesce(raw, 0)::DOUBLE AS raw_score, greatest(0, least(100, round_even(coalesce(raw, 0), 0)))::INTEGER AS score, coalesce(reasons, '') AS reasons FROM customer LEFT JOIN s ON case_id = c_custkey)
SELECT *, {_TIER} AS tier FROM t"""
)
def risk_score_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from all five kinds of evidence."""
    hits = evidence.active_hits(evidence.hits_by_document(case_evidence(spark, sf_dir), kind_rules(spark)))
    return risk.risk_score(hits, cases(spark, sf_dir).select("company_id", "case_id"))


@register(f"WITH {_EVIDENCE} SELECT check_type, name, severity, count(*) AS n FROM evidence WHERE kind = 'finding' AND severity IN ('medium', 'high') AND NOT (name = 'R' OR severity = 'high' OR (name = 'A' AND severity = 'medium')) GROUP BY ALL")
def uncovered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.uncovered(case_evidence(spark, sf_dir), kind_rules(spark))


@register(
    f"""WITH {_CHECKS}, s AS (
  SELECT company_id, case_id, sum(CASE WHEN rule_id LIKE 'metadata.%' THEN 0 ELSE weight END) AS plain, sum(CASE WHEN rule_id LIKE 'metadata.%' THEN weight ELSE 0 END) AS capped,
    string_agg(rule_id, ';' ORDER BY weight DESC, rule_id) AS reasons FROM hits GROUP BY ALL),
l AS (SELECT c_nationkey AS company_id, c_custkey AS case_id, CASE WHEN c_nationkey % 2 = 0 THEN 20 + c_nationkey ELSE 30 END AS medium, CASE WHEN c_nationkey % 2 = 0 THEN 50 + c_nationkey ELSE 60 END AS high, CASE WHEN c_nationkey % 2 = 0 THEN 5 + c_nationkey ELSE 40 END AS cap FROM customer),
r AS (SELECT l.company_id, l.case_id, medium, high, coalesce(plain, 0) + least(coalesce(capped, 0), cap) AS raw, coalesce(reasons, '') AS reasons FROM l LEFT JOIN s ON s.case_id = l.case_id AND s.company_id = l.company_id),
t AS (SELECT *, greatest(0, least(100, round_even(raw, 0)))::INTEGER AS score FROM r)
SELECT company_id, case_id, raw::DOUBLE AS raw_score, score, CASE WHEN score >= high THEN 'high' WHEN score >= medium THEN 'medium' ELSE 'low' END AS tier, reasons FROM t"""
)
def risk_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under the limits of each company; every other company has limits of its own."""
    n = F.col("n_nationkey")
    settings = read_table(spark, sf_dir, "nation").filter(n % 2 == 0).select(n.alias("company_id"), (20 + n).alias("medium_threshold"), (50 + n).alias("high_threshold"), (5 + n).alias("metadata_score_cap"))
    return risk.risk_score(risk.rule_hits(checks(spark, sf_dir), rules(spark)), cases(spark, sf_dir).select("company_id", "case_id"), settings)


@register(
    f"""WITH {_CHECKS}, f AS (SELECT case_id, sha256(string_agg(rule_id || ':' || n_documents, ',' ORDER BY rule_id)) AS fingerprint FROM hits GROUP BY 1)
SELECT * FROM f WHERE case_id % 3 > 0"""
)
def append_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scoring of all cases adds to stored assessments of every third."""
    new = risk.evidence_fingerprint(risk.rule_hits(checks(spark, sf_dir), rules(spark)))
    return risk.append_assessment(new.filter("case_id % 3 = 0"), new)


@register("SELECT o_custkey AS case_id, max(o_orderkey) AS fingerprint, max(o_orderdate) AS computed_at FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS newest FROM orders) WHERE o_orderdate = newest GROUP BY 1")
def latest_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assessments of their case."""
    rows = documents(spark, sf_dir).select("case_id", F.col("document_id").alias("fingerprint"), F.col("document_date").alias("computed_at"))
    return evidence.latest_assessment(rows)


_RESOLVED = """r AS (SELECT o_custkey AS case_id, CASE WHEN o_orderstatus = 'P' THEN 'no_issue' WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'conflict_confirmed' WHEN o_orderpriority = '1-URGENT' THEN 'open' ELSE 'no_issue' END AS resolution FROM orders)"""


@register(f"WITH {_RESOLVED} SELECT case_id, count(*) FILTER (WHERE resolution = 'open') AS n_open, count(*) FILTER (WHERE resolution = 'conflict_confirmed') AS n_confirmed, count(*) FILTER (WHERE resolution = 'no_issue') AS n_no_issue FROM r GROUP BY 1")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders are conflicts; finished ones are accepted, those in progress dismissed."""
    review = F.when(F.col("status") == "P", "dismissed").when(F.col("status") == "F", "accepted").otherwise("pending")
    kind = F.when(F.col("document_type") == "1-URGENT", "conflict").otherwise("harmless_variant")
    return evidence.finding_counts(documents(spark, sf_dir).select("case_id", identity.finding_resolution(kind, review).alias("resolution")))


@register(
    """SELECT c_custkey AS comparison_id, c_name AS case_name, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_conflicts, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS n_open
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"""
)
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = F.when(F.col("status") == "P", "dismissed").when(F.col("status") == "F", "accepted")
    kind = F.when(F.col("document_type") == "1-URGENT", "conflict").otherwise("harmless_variant")
    findings = documents(spark, sf_dir).select(F.col("case_id").alias("comparison_id"), kind.alias("classification"), review.alias("review_status"))
    return evidence.comparison_summary(cases(spark, sf_dir).select(F.col("case_id").alias("comparison_id"), "case_name"), findings)


@register("SELECT o_custkey AS case_id, CAST(least(100, sum(CASE o_orderpriority WHEN '1-URGENT' THEN 45 WHEN '2-HIGH' THEN 35 WHEN '3-MEDIUM' THEN 20 WHEN '5-LOW' THEN 10 ELSE 5 END)) AS BIGINT) AS points FROM orders GROUP BY 1")
def quick_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for x in ("1-URGENT", "critical", "2-HIGH", "high", "3-MEDIUM", "medium", "5-LOW", "low")))
    return risk.quick_risk(documents(spark, sf_dir).select("case_id", F.coalesce(F.element_at(kinds, F.col("document_type")), F.lit("info")).alias("severity")))


@register(
    """SELECT document_id, fin AS finding, (row_number() OVER (PARTITION BY document_id ORDER BY l_linenumber, fin, sev, l_partkey) - 1)::INTEGER AS idx, sev AS severity,
CASE sev WHEN 'high' THEN 75 WHEN 'medium' THEN 50 ELSE 25 END AS points
FROM (SELECT l_orderkey AS document_id, l_linenumber, l_partkey, l_returnflag AS fin, CASE WHEN l_quantity > 45 THEN 'high' WHEN l_quantity > 25 THEN 'medium' ELSE 'low' END AS sev FROM lineitem)"""
)
def explode_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as the array of findings of its check, with the points of their severity."""
    li = read_table(spark, sf_dir, "lineitem")
    severity = F.when(F.col("l_quantity") > 45, "high").when(F.col("l_quantity") > 25, "medium").otherwise("low")
    item = F.struct("l_linenumber", F.col("l_returnflag").alias("finding"), severity.alias("severity"), "l_partkey")
    held = li.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["finding"].alias("finding"), x["severity"].alias("severity"))).alias("details"))
    found = records.explode_findings(held)
    return found.select("document_id", "finding", "idx", "severity", identity.finding_severity_score(F.col("severity")).alias("points"))


@register(f"WITH {_CHECKS} SELECT document_id, sub_check, status FROM checks")
def explode_sub_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a document put into one map and taken out again."""
    found = checks(spark, sf_dir)
    held = found.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("sub_check", "status"))).alias("sub_checks"))
    return records.explode_sub_checks(held)


@register(
    f"""WITH c AS (SELECT * FROM (VALUES {_RULE_VALUES}) AS r({RULE_COLUMNS}) QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY version DESC) = 1),
e AS (SELECT n_nationkey AS company_id, rule_id, version, weight, CASE WHEN n_nationkey % 2 = 0 THEN weight ELSE weight + n_nationkey END AS wanted FROM c CROSS JOIN nation)
SELECT company_id, rule_id, version + 1 AS version, wanted AS weight FROM e WHERE wanted <> weight"""
)
def rule_new_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of the rules by every company, of which half change nothing."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("company_id"))
    held = spark.sql(f"SELECT * FROM VALUES {_RULE_VALUES} AS r({RULE_COLUMNS})")
    newest = held.groupBy("rule_id").agg(F.max("version").alias("version"), F.max_by("weight", "version").alias("weight"))
    current = records.seed_rules(newest.withColumn("is_active", F.lit(True)), n, newest.select(F.lit(-1).alias("company_id"), "rule_id"))
    edits = current.select("company_id", "rule_id", F.when(F.col("company_id") % 2 == 0, F.col("weight")).otherwise(F.col("weight") + F.col("company_id")).alias("weight"))
    return records.rule_new_version(current, edits, ["company_id", "rule_id"], ["weight"])


@register(f"SELECT n_nationkey AS company_id, rule_id, version, weight FROM nation CROSS JOIN (SELECT * FROM (VALUES {_RULE_VALUES}) AS r({RULE_COLUMNS}) WHERE is_active AND version = 1) WHERE NOT (n_nationkey % 3 = 0 AND rule_id LIKE 'field.%')")
def seed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third company has the field rules already."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("company_id"))
    templates = spark.sql(f"SELECT rule_id, version, weight, is_active FROM VALUES {_RULE_VALUES} AS r({RULE_COLUMNS}) WHERE version = 1")
    have = records.seed_rules(templates.filter("rule_id LIKE 'field.%'"), n.filter("company_id % 3 = 0"), templates.select(F.lit(-1).alias("company_id"), "rule_id"))
    return records.seed_rules(templates, n, have.select("company_id", "rule_id")).select("company_id", "rule_id", "version", "weight")


@register(
    """WITH c AS (SELECT o_orderkey AS case_id, o_custkey AS submitted_by, CASE WHEN o_orderkey % 3 = 0 THEN c_nationkey END AS family_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 40 END AS member_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
f AS (SELECT c_nationkey AS family_id, min(c_custkey) AS head FROM customer GROUP BY 1), m AS (SELECT c_custkey AS member_id, c_nationkey AS family_id, c_custkey AS user_id FROM customer WHERE c_custkey < 40)
SELECT submitted_by AS user_id, case_id FROM c UNION SELECT user_id, case_id FROM c JOIN m USING (member_id) UNION SELECT head, case_id FROM c JOIN f USING (family_id)
UNION SELECT head, case_id FROM c JOIN m USING (member_id) JOIN f ON f.family_id = m.family_id"""
)
def case_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases, customers as submitters, nations as families with their first customer as head."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("submitted_by"), F.col("c_nationkey").cast("long").alias("nation"))
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("submitted_by")).join(c, "submitted_by", "left")
    held = o.select("case_id", "submitted_by", F.when(F.col("case_id") % 3 == 0, F.col("nation")).alias("family_id"), F.when(F.col("case_id") % 5 == 0, F.col("case_id") % 40).alias("member_id"))
    families = c.groupBy(F.col("nation").alias("family_id")).agg(F.min("submitted_by").alias("head_user_id"))
    members = c.filter("submitted_by < 40").select(F.col("submitted_by").alias("member_id"), F.col("nation").alias("family_id"), F.col("submitted_by").alias("user_id"))
    return access.case_visibility(held, families, members)


@register(
    """WITH u AS (SELECT s_suppkey AS user_id, s_nationkey AS company_id, s_suppkey % 4 AS rank, s_suppkey % 11 = 0 AS platform FROM supplier),
c AS (SELECT c_custkey AS case_id, c_nationkey AS company_id, CASE WHEN c_custkey % 3 = 0 THEN 'l2' ELSE 'l1' END AS tier FROM customer)
SELECT company_id, tier, count(*) AS n, count(*) FILTER (WHERE NOT platform AND rank >= CASE tier WHEN 'l2' THEN 2 ELSE 1 END) AS n_allowed FROM c JOIN u USING (company_id) GROUP BY 1, 2"""
)
def can_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as users of the company of their nation: of how many pairs of user role and case tier each may act.

    Users are counted by what decides, so a company's cases meet a few groups of its users and not each of them."""
    roles = F.array(*map(F.lit, access.RANKS))
    users = read_table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("company_id"), F.element_at(roles, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("role"), (F.col("s_suppkey") % 11 == 0).alias("platform")).agg(F.count("*").alias("n_users"))
    held = cases(spark, sf_dir).groupBy("company_id", F.when(F.col("case_id") % 3 == 0, "l2").otherwise("l1").alias("tier")).agg(F.count("*").alias("n_cases"))
    met = held.join(users, "company_id").withColumn("n", F.col("n_users") * F.col("n_cases"))
    allowed = access.can_act(F.col("role"), F.col("company_id"), F.col("company_id"), F.col("tier"), F.col("platform"))
    return met.groupBy("company_id", "tier").agg(F.sum("n").alias("n"), F.sum(F.when(allowed, F.col("n")).otherwise(0)).alias("n_allowed"))


@register("SELECT c_custkey AS case_id, 'pending' AS tier, 'In review' AS flags FROM customer")
def mask_flag_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as a submitter is shown them."""
    found = scores(spark, sf_dir).select("case_id", "tier", "score", F.col("reasons").alias("flags"))
    return access.mask_flags(found, "user").drop("score")


@register(
    """SELECT o_orderkey AS case_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'l2' ELSE 'l1' END AS tier, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, o_orderdate AS created_at FROM orders
ORDER BY CASE WHEN tier = 'l2' AND status <> 'closed' THEN 0 ELSE 1 END, created_at DESC, case_id"""
)
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(
        F.col("document_id").alias("case_id"), F.when(F.col("document_type") == "1-URGENT", "l2").otherwise("l1").alias("tier"), F.when(F.col("status") == "F", "closed").otherwise("open").alias("status"), F.col("document_date").alias("created_at")
    )
    return access.queue_order(rows)


@register(
    f"""WITH {_SCORE}, d AS (SELECT o_custkey AS case_id, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS waiting FROM orders GROUP BY 1)
SELECT c_nationkey AS bulk_id, c_name AS folder, c_custkey AS case_id, CASE WHEN c_custkey % 17 = 0 THEN 'bad' END AS error,
CASE WHEN c_custkey % 17 = 0 THEN 'failed' WHEN coalesce(n, 0) = coalesce(waiting, 0) THEN 'queued' WHEN done < n THEN 'processing' WHEN {_TIER} IN ('medium', 'high') THEN 'flagged' ELSE 'done' END AS live
FROM customer LEFT JOIN d ON d.case_id = c_custkey LEFT JOIN scores ON scores.case_id = c_custkey"""
)
def bulk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as folders of their nation's archive."""
    folders = cases(spark, sf_dir).select(F.col("company_id").alias("bulk_id"), F.col("case_name").alias("folder"), "case_id", F.when(F.col("case_id") % 17 == 0, "bad").alias("error"))
    state = F.when(F.col("status") == "F", "completed").when(F.col("status") == "O", "pending").otherwise("running")
    return access.bulk_status(folders, documents(spark, sf_dir).select("case_id", state.alias("status")), scores(spark, sf_dir))


@register(f"WITH {_CHECKS} SELECT company_id, case_id, document_id, sub_check AS check_type, status AS outcome, coalesce(max(CASE WHEN status = 'flag' THEN weight END), 0)::DOUBLE AS weight FROM checks LEFT JOIN rules USING (sub_check, status) GROUP BY ALL")
def report_check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check with its outcome and the weight of the rule that it fires."""
    return reporting.report_check_rows(checks(spark, sf_dir), rules(spark))


@register(
    """SELECT document_id, field, value FROM (SELECT o_orderkey AS document_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total_amount, strftime(o_orderdate, '%Y-%m-%d') AS document_date, o_orderpriority AS document_type FROM orders)
UNPIVOT (value FOR field IN (total_amount, document_date, document_type))"""
)
def report_field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("document_id", F.col("total_amount").cast("decimal(18,2)").cast("string").alias("total_amount"), F.date_format("document_date", "yyyy-MM-dd").alias("document_date"), "document_type")
    return reporting.report_field_rows(d, ["document_id"], ["total_amount", "document_date", "document_type"])


@register(
    f"""WITH {_SCORE}, d AS (SELECT o_custkey AS case_id, count(*) AS n_documents, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY 1),
c AS (SELECT case_id, count(*) FILTER (WHERE status = 'flag') AS n_flagged, count(*) FILTER (WHERE status = 'skipped') AS n_skipped FROM checks GROUP BY 1)
SELECT scores.case_id, score, {_TIER} AS tier, reasons, coalesce(n_documents, 0) AS n_documents, first_date, last_date, coalesce(n_flagged, 0) AS n_flagged, coalesce(n_skipped, 0) AS n_skipped
FROM scores LEFT JOIN d ON d.case_id = scores.case_id LEFT JOIN c ON c.case_id = scores.case_id"""
)
def report_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each case with the sums of all sections of its report."""
    return reporting.report_case(scores(spark, sf_dir), documents(spark, sf_dir), checks(spark, sf_dir))


@register("SELECT o_orderpriority AS queue, min(o_orderdate) AS oldest, CAST(epoch(TIMESTAMP '1999-01-01 00:00:00' - min(o_orderdate)) AS BIGINT) AS age FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING age > 300")
def stream_queue_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.readStream.schema(read_table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/order[s].parquet")
    waiting = o.filter("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("queue"), F.col("o_orderdate").alias("enqueued"))
    return monitor.run_to_table(monitor.queue_alert(waiting, "1999-01-01 00:00:00", 300), "alert")


@register("WITH c AS (SELECT user_id, max(ts) AS cutoff FROM events WHERE event_type = 'error' GROUP BY 1) SELECT event_id, user_id, event_type FROM events JOIN c USING (user_id) WHERE ts < cutoff")
def stream_token_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error of a user as the time at which all older tokens were revoked."""
    cutoffs = read_table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("cutoff"))
    revoked = monitor.token_cutoff(streamed(spark, sf_dir), cutoffs)
    return monitor.run_to_table(revoked.select("event_id", "user_id", "event_type"), "cutoff", "append")


@register(f"WITH {_CHECKS} SELECT case_id, sha256(string_agg(rule_id || ':' || n_documents, ',' ORDER BY rule_id)) AS fingerprint FROM hits WHERE case_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def stream_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders ask for the assessment of their case."""

    def assess(wanted: DataFrame) -> DataFrame:
        found = checks(spark, sf_dir).join(wanted, "case_id", "left_semi")
        return risk.evidence_fingerprint(risk.rule_hits(found, rules(spark)))

    return monitor.rescore(streamed_documents(spark, sf_dir).filter("status = 'F'"), assess, "case_id bigint, fingerprint string")


@register("SELECT o_custkey AS case_id, o_orderpriority AS check_type, max(o_orderkey) AS document_id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2")
def stream_late_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later orders of a case and kind replace the result of earlier ones."""
    o = spark.readStream.schema(read_table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/order[s].parquet")
    results = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("check_type"), F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("status"))
    return monitor.late_evidence(results, ["case_id", "check_type"], "document_id")


@register(
    """WITH p AS (SELECT * FROM (VALUES ('last_30_days', DATE '2024-01-01', DATE '2024-01-30'), ('this_month', DATE '2024-01-01', DATE '2024-01-30'), ('last_month', DATE '2023-12-01', DATE '2023-12-31'), ('this_year', DATE '2024-01-01', DATE '2024-01-30')) AS p(period, a, b))
SELECT period, count(event_id) AS n FROM p LEFT JOIN events ON CAST(ts AS DATE) BETWEEN a AND b GROUP BY 1"""
)
def usage_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within each named period, as of 30 January 2024; one pass over the events."""
    day, today = F.to_date("ts"), F.lit("2024-01-30").cast("date")
    named = ("last_30_days", "this_month", "last_month", "this_year")
    within = {p: F.count_if(day.between(*access.usage_period(p, today))) for p in named}
    row = read_table(spark, sf_dir, "events").agg(*(c.alias(p) for p, c in within.items()))
    return row.unpivot([], list(named), "period", "n")
