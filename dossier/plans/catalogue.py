"""Registered queries over the driver tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions import text as fn
from dossier.operators import cross_document, operations, risk, similarity, validation
from dossier.plans.tables import cases, documents, lines, plain_lines
from dossier.storage import read_table

TODAY, CUTOFF = "1998-01-01 00:00:00", "1997-01-01 00:00:00"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Rules as data: company (null: all), rule, version, sub-check, status, weight, active.
RULES = (
    ("field.line_item_arithmetic", 1, "line_item_arithmetic", "flag", 25.0, True),
    ("field.subtotal_line_item", 1, "line_items_sum", "flag", 15.0, True),
    ("field.date_in_future", 1, "date_in_future", "flag", 20.0, True),
    ("field.date_in_future", 2, "date_in_future", "flag", 25.0, True),
    ("metadata.date_sequence", 1, "date_sequence", "flag", 15.0, True),
    ("metadata.tax_rate", 1, "tax_rate", "flag", 30.0, True),
    ("field.unused", 1, "line_items_sum", "pass", 40.0, True),
    ("field.unused", 2, "line_items_sum", "pass", 40.0, False),
)
RULE_COLUMNS = "rule_id, version, sub_check, status, weight, is_active"
_RULE_VALUES = ", ".join(f"('{r}', {v}, '{c}', '{s}', CAST({w} AS DOUBLE), {str(a).lower()})" for r, v, c, s, w, a in RULES)


def register(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rules(spark: SparkSession) -> DataFrame:
    found = spark.sql(f"SELECT * FROM VALUES {_RULE_VALUES} AS r({RULE_COLUMNS})").withColumn("company_id", F.lit(0))
    return risk.rule_current(found).select("rule_id", "sub_check", "status", "weight")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = documents(spark, sf_dir).join(cases(spark, sf_dir).select("company_id", "case_id"), "case_id")
    found = validation.document_checks(owned, lines(spark, sf_dir, "left"), TODAY, ("company_id", "case_id"))
    return found.select("company_id", "case_id", "document_id", "sub_check", "status")


_ARITHMETIC = """SELECT l_orderkey AS document_id, count(*) AS n_lines,
  count(*) FILTER (WHERE abs(l_quantity * p_retailprice - 0.0 - l_extendedprice) > 0.02 + 0.005 * l_quantity + 1e-9) AS n_wrong
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""
_SUM = """SELECT o_orderkey AS document_id, line_sum, round(abs(line_sum - o_totalprice), 2) AS difference,
  CASE WHEN line_sum IS NULL THEN 'skipped' WHEN abs(line_sum - o_totalprice) > 0.01 * greatest(n, 1) + 1e-9 THEN 'flag' ELSE 'pass' END AS status
  FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS line_sum, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
_FUTURE = f"SELECT o_orderkey AS document_id, CASE WHEN o_orderdate IS NULL THEN 'skipped' WHEN o_orderdate > TIMESTAMP '{TODAY}' THEN 'flag' ELSE 'pass' END AS status FROM orders"
_SEQUENCE = """SELECT o_orderkey AS document_id, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS n_early, count(l_shipdate) AS n_lines
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
_TAX = "SELECT l_orderkey AS document_id, count(DISTINCT l_tax) AS n_rates, max(l_tax) AS top_rate FROM lineitem GROUP BY 1"
_SEQUENCE_STATUS = "CASE WHEN n_lines = 0 THEN 'skipped' WHEN n_early > 0 THEN 'flag' ELSE 'pass' END"
_CHECKS = f"""checks AS (
  SELECT c_nationkey AS company_id, o_custkey AS case_id, document_id, sub_check, status FROM (
    SELECT document_id, 'line_item_arithmetic' AS sub_check, CASE WHEN n_wrong > 0 THEN 'flag' ELSE 'pass' END AS status FROM ({_ARITHMETIC})
    UNION ALL SELECT document_id, 'line_items_sum', status FROM ({_SUM})
    UNION ALL SELECT document_id, 'date_in_future', status FROM ({_FUTURE})
    UNION ALL SELECT document_id, 'date_sequence', {_SEQUENCE_STATUS} FROM ({_SEQUENCE})
    UNION ALL SELECT document_id, 'tax_rate', CASE WHEN n_rates > 1 THEN 'flag' ELSE 'pass' END FROM ({_TAX})
  ) JOIN orders ON o_orderkey = document_id JOIN customer ON c_custkey = o_custkey
), rules AS (
  SELECT rule_id, arg_max(sub_check, version) AS sub_check, arg_max(status, version) AS status, arg_max(weight, version) AS weight
  FROM (VALUES {_RULE_VALUES}) AS r({RULE_COLUMNS}) GROUP BY rule_id HAVING arg_max(is_active, version)
), hits AS (
  SELECT company_id, case_id, rule_id, weight, count(DISTINCT document_id) AS n_documents FROM checks JOIN rules USING (sub_check, status) GROUP BY ALL
)"""
_SCORE = f"""{_CHECKS}, sums AS (
  SELECT company_id, case_id, sum(CASE WHEN rule_id LIKE 'metadata.%' THEN 0 ELSE weight END) + least(sum(CASE WHEN rule_id LIKE 'metadata.%' THEN weight ELSE 0 END), 40) AS raw,
    string_agg(rule_id, ';' ORDER BY weight DESC, rule_id) AS reasons FROM hits GROUP BY ALL
), scores AS (
  SELECT c_nationkey AS company_id, c_custkey AS case_id, coalesce(raw, 0)::DOUBLE AS raw_score, greatest(0, least(100, round_even(coalesce(raw, 0), 0)))::INTEGER AS score, coalesce(reasons, '') AS reasons
  FROM customer LEFT JOIN sums ON sums.case_id = c_custkey AND sums.company_id = c_nationkey
)"""
_TIER = "CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END"


@register(f"WITH {_SCORE} SELECT company_id, case_id, raw_score, score, {_TIER} AS tier, reasons FROM scores")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: five checks over documents and lines, rules as data, one score for each case."""
    hits = risk.rule_hits(checks(spark, sf_dir), rules(spark))
    return risk.risk_score(hits, cases(spark, sf_dir).select("company_id", "case_id"))


@register(f"WITH {_CHECKS} SELECT * FROM hits")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.rule_hits(checks(spark, sf_dir), rules(spark))


@register(f"WITH {_CHECKS} SELECT company_id, case_id, document_id, sub_check, status FROM checks WHERE status = 'flag' AND sub_check <> 'tax_rate'")
def unmatched_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged sub-checks under a rule pack that speaks of the tax rate alone."""
    return risk.unmatched_findings(checks(spark, sf_dir), rules(spark).filter("sub_check = 'tax_rate'"))


@register(f"WITH {_CHECKS} SELECT case_id, sha256(string_agg(rule_id || ':' || n_documents, ',' ORDER BY rule_id)) AS fingerprint FROM hits GROUP BY 1")
def evidence_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.evidence_fingerprint(risk.rule_hits(checks(spark, sf_dir), rules(spark)))


@register(
    f"""WITH {_SCORE}, parts AS (SELECT case_id, {_TIER} AS tier, list_filter(string_split(reasons, ';'), lambda x: x <> '') AS t FROM scores)
SELECT case_id, tier, concat_ws(', ', array_to_string(t[1:3], ', '), CASE WHEN len(t) > 3 THEN '+' || (len(t) - 3) || ' more' END) AS flags FROM parts"""
)
def case_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = cases(spark, sf_dir)
    return risk.case_flags(owned, risk.risk_score(risk.rule_hits(checks(spark, sf_dir), rules(spark)), owned.select("company_id", "case_id")))


@register(f"SELECT *, CASE WHEN n_wrong > 0 THEN 'flag' ELSE 'pass' END AS status FROM ({_ARITHMETIC})")
def chk_line_item_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.chk_line_item_arithmetic(lines(spark, sf_dir))


@register(_SUM)
def chk_line_items_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.chk_line_items_sum(documents(spark, sf_dir), plain_lines(spark, sf_dir))


@register(_FUTURE)
def chk_date_in_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.chk_date_in_future(documents(spark, sf_dir), TODAY)


@register(f"SELECT *, {_SEQUENCE_STATUS} AS status FROM ({_SEQUENCE})")
def chk_date_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("document_id", "document_date")
    return validation.chk_date_sequence(docs.join(plain_lines(spark, sf_dir).select("document_id", "line_date"), "document_id", "left"))


@register(f"SELECT *, CASE WHEN n_rates > 1 THEN 'flag' ELSE 'pass' END AS status FROM ({_TAX})")
def chk_tax_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.chk_tax_rate(plain_lines(spark, sf_dir))


@register(
    """WITH sums AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS subtotal, CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE) AS tax FROM lineitem GROUP BY 1)
SELECT o_orderkey AS document_id, CASE WHEN subtotal IS NULL THEN 'skipped' WHEN abs(subtotal + coalesce(tax, 0) - o_totalprice) > 0.02 + 1e-9 THEN 'flag' ELSE 'pass' END AS status
FROM orders LEFT JOIN sums ON l_orderkey = o_orderkey"""
)
def chk_total_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda c: F.sum(c.cast("decimal(18,4)")).cast("double")
    sums = plain_lines(spark, sf_dir).groupBy("document_id").agg(money(F.col("total")).alias("subtotal"), money(F.col("total") * F.col("tax_rate")).alias("tax"))
    return validation.chk_total_tax(documents(spark, sf_dir).join(sums, "document_id", "left"))


@register("SELECT o_custkey AS case_id, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_documents FROM orders GROUP BY ALL HAVING count(*) > 1")
def chk_multiple_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.chk_multiple_invoices(documents(spark, sf_dir))


@register(
    """WITH bad AS (SELECT DISTINCT a.o_custkey AS case_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
  AND abs(a.o_totalprice - b.o_totalprice) > greatest(0.01 * greatest(abs(a.o_totalprice), abs(b.o_totalprice)), 0.01))
SELECT o_custkey AS case_id, count(*) AS n_documents, min(o_totalprice) AS low, max(o_totalprice) AS high, round(max(o_totalprice) - min(o_totalprice), 2) AS difference
FROM orders WHERE o_custkey IN (FROM bad) GROUP BY 1"""
)
def cross_document_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_document.cross_document_mismatch(documents(spark, sf_dir).withColumnRenamed("total_amount", "amount"))


@register(
    """WITH d AS (SELECT o_custkey AS case_id, o_orderkey AS document_id, o_totalprice AS amount, o_totalprice::DECIMAL(18,4) AS x FROM orders)
SELECT a.case_id, a.document_id, any_value(a.amount) AS amount, count(*) FILTER (WHERE b.x < a.x) AS n_below, count(*) FILTER (WHERE b.x > a.x) AS n_above,
max(b.x) FILTER (WHERE b.x < a.x)::DOUBLE AS nearest_below, min(b.x) FILTER (WHERE b.x > a.x)::DOUBLE AS nearest_above
FROM d a JOIN d b ON a.case_id = b.case_id AND a.document_id <> b.document_id AND abs(a.x - b.x) > greatest(0.01 * greatest(abs(a.x), abs(b.x)), 0.01) GROUP BY 1, 2"""
)
def cross_document_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_document.amount_outliers(documents(spark, sf_dir).withColumnRenamed("total_amount", "amount"))


@register(
    """SELECT o_custkey AS case_id, o_orderpriority AS value, count(*) AS n_documents, min(o_orderkey) AS first_document, count(*) OVER (PARTITION BY o_custkey) = 1 AS agreed
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2"""
)
def cross_document_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_document.value_classes(documents(spark, sf_dir), "document_type")


@register(
    """WITH n AS (SELECT o_custkey AS case_id, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT case_id, arg_min(value, struct_pack(a := -n, b := value)) AS value, CASE WHEN max(n) = sum(n) THEN 'agreed' WHEN 2 * max(n) > sum(n) THEN 'majority' ELSE 'conflict' END AS status FROM n GROUP BY 1"""
)
def verified_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document type as a profile field: what most documents of a case say, and whether they agree."""
    return cross_document.majority_value(documents(spark, sf_dir), "document_type")


@register(
    """SELECT c_custkey AS case_id, count(o_orderkey) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'P') AS started
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def document_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.document_progress(cases(spark, sf_dir), documents(spark, sf_dir))


@register(
    """WITH n AS (SELECT o_custkey, count(*) AS n_documents, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, max(o_orderdate) AS newest FROM orders GROUP BY 1)
SELECT c_nationkey AS company_id, c_custkey AS case_id, c_name AS case_name, c_mktsegment AS case_type, n_documents, n_open, newest FROM customer JOIN n ON o_custkey = c_custkey WHERE n_open > 0"""
)
def case_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.case_queue(cases(spark, sf_dir), documents(spark, sf_dir)).select("company_id", "case_id", "case_name", "case_type", "n_documents", "n_open", "newest")


@register(f"SELECT o_orderkey AS document_id, o_custkey AS case_id, o_orderdate AS document_date FROM orders WHERE o_orderdate < TIMESTAMP '{CUTOFF}' AND o_orderstatus = 'F'")
def retention_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.retention_due(documents(spark, sf_dir), CUTOFF).select("document_id", "case_id", "document_date")


@register(f"SELECT o_orderkey AS document_id, o_orderdate AS document_date FROM orders WHERE o_orderdate < TIMESTAMP '{CUTOFF}' AND o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def oldest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = operations.retention_due(documents(spark, sf_dir), CUTOFF).select("document_id", "document_date")
    return operations.oldest_batch(due, 100, "document_date", "document_id")


@register(
    """SELECT event_id, e.ts, e.user_id, event_type, c_name AS actor FROM events e LEFT JOIN customer ON c_custkey = user_id
WHERE event_type IN ('error', 'signup') AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND contains(lower(c_name), '1')"""
)
def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    actors = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("actor"))
    return operations.audit_search(read_table(spark, sf_dir, "events"), actors, "1", ("error", "signup"), "2024-01-10 00:00:00").select("event_id", "ts", "user_id", "event_type", "actor")


@register(
    """SELECT user_id, event_id, event_type, row_number() OVER w AS place, greatest(count(*) OVER (PARTITION BY user_id) - 3, 0) AS truncated
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER w <= 3"""
)
def audit_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.audit_excerpt(read_table(spark, sf_dir, "events"), 3).select("user_id", "event_id", "event_type", F.col("place").cast("long").alias("place"), "truncated")


@register("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


_USAGE = """SELECT user_id, CAST(ts AS DATE) AS usage_date, count(*) FILTER (WHERE event_type = 'view') AS n_views, count(*) FILTER (WHERE event_type = 'click') AS n_clicks,
  count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS amount FROM events GROUP BY 1, 2"""
_COUNTERS = ["n_views", "n_clicks", "n_purchases"]


@register(_USAGE)
def usage_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.usage_true(read_table(spark, sf_dir, "events"))


@register(f"SELECT user_id, sum(n_views)::BIGINT AS n_views, sum(n_clicks)::BIGINT AS n_clicks, sum(n_purchases)::BIGINT AS n_purchases FROM ({_USAGE}) GROUP BY ROLLUP (user_id)")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.usage_totals(operations.usage_true(read_table(spark, sf_dir, "events")), "user_id", _COUNTERS)


@register(
    f"""WITH t AS ({_USAGE}), s AS (SELECT user_id, CAST(ts AS DATE) AS usage_date, count(*) FILTER (WHERE event_type = 'view' AND value >= 1) AS n_views,
  count(*) FILTER (WHERE event_type = 'click') AS n_clicks, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases FROM events WHERE event_type <> 'signup' GROUP BY 1, 2)
SELECT coalesce(s.user_id, t.user_id) AS user_id, coalesce(s.usage_date, t.usage_date) AS usage_date, coalesce(s.n_views, 0) AS n_views_was, coalesce(s.n_clicks, 0) AS n_clicks_was,
  coalesce(s.n_purchases, 0) AS n_purchases_was, coalesce(t.n_views, 0) AS n_views_now, coalesce(t.n_clicks, 0) AS n_clicks_now, coalesce(t.n_purchases, 0) AS n_purchases_now
FROM s FULL OUTER JOIN t ON s.user_id = t.user_id AND s.usage_date = t.usage_date
WHERE coalesce(s.n_views, 0) <> coalesce(t.n_views, 0) OR coalesce(s.n_clicks, 0) <> coalesce(t.n_clicks, 0) OR coalesce(s.n_purchases, 0) <> coalesce(t.n_purchases, 0)"""
)
def usage_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counters that missed small views and sign-up days, against those worked out again."""
    events = read_table(spark, sf_dir, "events")
    stored = operations.usage_true(events.filter("event_type <> 'signup' AND (event_type <> 'view' OR value >= 1)"))
    missing = operations.usage_true(events.filter("event_type <> 'signup'")).select("user_id", "usage_date")
    stored = missing.join(stored, ["user_id", "usage_date"], "left").fillna(0)
    return operations.usage_reconcile(stored, operations.usage_true(events), _COUNTERS)


@register(
    """SELECT event_type, time_bucket(INTERVAL 15 MINUTES, ts) AS window_start, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS longest FROM events GROUP BY 1, 2"""
)
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.queue_metrics(read_table(spark, sf_dir, "events"))


@register(
    """WITH n AS (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT event_type, max(n) AS peak FROM n GROUP BY 1"""
)
def peak_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.peak_in_window(read_table(spark, sf_dir, "events"), 3600)


@register(
    """WITH d AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS delta FROM events),
o AS (SELECT event_id, user_id, event_type, greatest(coalesce(sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS outstanding FROM d)
SELECT event_id, user_id, outstanding, least(9, outstanding // 5)::BIGINT AS priority FROM o WHERE event_type = 'click'"""
)
def fair_share_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.fair_share_priority(read_table(spark, sf_dir, "events"))


@register(
    """WITH g AS (SELECT *, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) <= 7200 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM g)
SELECT user_id, session_no, min(ts) AS started, count(*) AS n_events FROM s GROUP BY 1, 2"""
)
def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.sessions_by_gap(read_table(spark, sf_dir, "events"), 7200)


@register("SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events GROUP BY 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.latest_per_key(read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@register(
    """WITH k AS (SELECT DISTINCT o_orderpriority AS check_type FROM orders), n AS (SELECT count(*) AS n_cases FROM customer),
r AS (SELECT o_orderpriority AS check_type, count(DISTINCT o_custkey) AS n_ran, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_flagged FROM orders GROUP BY 1)
SELECT k.check_type, coalesce(n_ran, 0) AS n_ran, coalesce(n_flagged, 0) AS n_flagged, n_cases - coalesce(n_ran, 0) AS n_missing FROM k CROSS JOIN n LEFT JOIN r USING (check_type)"""
)
def check_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("case_id", F.col("document_type").alias("check_type"), (F.col("status") == "P").alias("flagged"))
    return operations.check_coverage(cases(spark, sf_dir), found, found.select("check_type").distinct())


@register("WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents) SELECT doc_id, sha256, min(doc_id) OVER (PARTITION BY sha256) AS first, count(*) OVER (PARTITION BY sha256) AS copies FROM h QUALIFY copies > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.exact_duplicates(read_table(spark, sf_dir, "documents"), "text", "doc_id")


@register("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.content_sha256(read_table(spark, sf_dir, "documents"), "text", "doc_id")


_BITS = " + ".join(f"(CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN 1::UBIGINT << {i} ELSE 0::UBIGINT END)" for i in range(64))
_SIGNED = "CASE WHEN {0} >= 9223372036854775808 THEN ({0}::HUGEINT - 18446744073709551616)::BIGINT ELSE {0}::BIGINT END"


@register(
    f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w),
h AS (SELECT doc_id, ('0x' || substr(md5(array_to_string(w[i:i + 2], ' ')), 1, 16))::UBIGINT AS h FROM s),
p AS (SELECT doc_id, {_BITS} AS p FROM h GROUP BY 1), d AS (SELECT {_SIGNED.format("p")} AS phash, p, min(doc_id) AS first FROM p GROUP BY ALL)
SELECT a.phash AS phash_a, a.first AS first_a, b.phash AS phash_b, b.first AS first_b, bit_count(xor(a.p, b.p))::INTEGER AS distance FROM d a JOIN d b ON a.first < b.first AND bit_count(xor(a.p, b.p)) <= 5
QUALIFY row_number() OVER (PARTITION BY b.phash ORDER BY bit_count(xor(a.p, b.p)), a.first) = 1"""
)
def phash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = similarity.shingle_hashes(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return similarity.near_duplicates(similarity.vote(docs, "doc_id", "hashes"), "doc_id")


@register(
    """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (
SELECT q.vec_id AS query, r.vec_id AS match, round(list_cosine_similarity(q.e, r.embedding::DOUBLE[]), 9) AS similarity FROM q JOIN embeddings r ON q.vec_id <> r.vec_id)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, match) <= 10"""
)
def photo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are every row whose id is divisible by 50, against all rows."""
    rows = read_table(spark, sf_dir, "embeddings")
    return similarity.vector_search(rows.filter("vec_id % 50 = 0"), rows, 10)


_GAP = r"(?:\x02[ -]\x01)?"
_SHAPES_SQL = f"[A-Z]{{2}}{_GAP}[0-9]{{2}}{_GAP}(?:19|20)[0-9]{{2}}{_GAP}[0-9]{{7}}|(?:[0-9Xx*#]{{4}}{_GAP}){{2}}[0-9]{{4}}|[A-Z]{{5}}[0-9]{{4}}[A-Z]|[A-Z]{{3}}[0-9]{{7}}|[A-Z][0-9]{{7}}"


@register(
    rf"""WITH p AS (SELECT doc_id, text || chr(10) || upper(substr(source, 1, 3)) || lpad(CAST(doc_id % 7 AS VARCHAR), 7, '1') || ' ' || lpad(CAST(doc_id AS VARCHAR), 4, '2') || '-3333 4444, P' || lpad(CAST(doc_id % 7 AS VARCHAR), 7, '5') || '/P' || lpad(CAST(doc_id % 3 AS VARCHAR), 7, '5') || ' X12345678' AS text FROM documents),
m AS (SELECT doc_id, regexp_replace(text, '([A-Za-z0-9*#]+)', chr(1) || '\1' || chr(2), 'g') AS t FROM p),
f AS (SELECT doc_id, regexp_extract_all(t, '\x01(?:{_SHAPES_SQL})\x02') AS found, string_split_regex(t, '\x01(?:{_SHAPES_SQL})\x02') AS rest FROM m),
n AS (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i) AS numbers FROM f)
SELECT doc_id, translate(array_to_string(list_transform(rest, lambda r, i: r || CASE WHEN i <= len(found) THEN '[ID_NUMBER_' || list_position(numbers, found[i]) || ']' ELSE '' END), ''), chr(1) || chr(2), '') AS masked, len(numbers) AS n_numbers, true AS restored FROM n"""
)
def mask_id_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a line of numbers of three shapes, of which the last is one digit too long; the numbers go back as well."""
    docs, key = read_table(spark, sf_dir, "documents"), F.col("doc_id")
    digits = lambda c, n, fill: F.lpad(c.cast("string"), n, fill)
    line = F.concat(
        F.lit("\n"), F.upper(F.substring("source", 1, 3)), digits(key % 7, 7, "1"), F.lit(" "), digits(key, 4, "2"), F.lit("-3333 4444, P"),
        digits(key % 7, 7, "5"), F.lit("/P"), digits(key % 3, 7, "5"), F.lit(" X12345678"),
    )
    printed = docs.select("doc_id", F.concat("text", line).alias("text")).withColumns({"masked": fn.mask_id_numbers(F.col("text")), "numbers": fn.id_numbers(F.col("text"))})
    same = fn.restore_id_numbers(F.col("masked"), F.col("numbers")) == F.col("text")
    return printed.select("doc_id", "masked", F.size("numbers").alias("n_numbers"), same.alias("restored"))


@register("SELECT c_custkey AS case_id, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS label FROM customer")
def fn_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("case_id", fn.slug(F.col("case_name")).alias("slug"), fn.humanize(F.col("case_type")).alias("label"))


@register(
    """WITH p AS (SELECT o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS a, CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS b FROM orders)
SELECT document_id, CASE WHEN a = b THEN NULL WHEN year(a) <> year(b) THEN 'year_difference' WHEN month(a) = day(b) AND day(a) = month(b) THEN 'day_month_swapped'
WHEN levenshtein(strftime(a, '%Y%m%d'), strftime(b, '%Y%m%d')) = 1 THEN 'minor' ELSE 'difference' END AS verdict FROM p WHERE b IS NOT NULL"""
)
def compare_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's date against that of the document before it in its case."""
    w = W.partitionBy("case_id").orderBy("document_date", "document_id")
    pairs = documents(spark, sf_dir).select("document_id", F.to_date("document_date").alias("a"), F.to_date(F.lag("document_date").over(w)).alias("b"))
    return pairs.filter("b IS NOT NULL").select("document_id", fn.compare_dates(F.col("a"), F.col("b")).alias("verdict"))


@register(
    """WITH p AS (SELECT o_orderkey AS document_id, o_totalprice AS a, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
r AS (SELECT *, greatest(a, b) / least(a, b) AS r FROM p WHERE b IS NOT NULL)
SELECT document_id, CASE WHEN a <= 0 OR b <= 0 THEN NULL WHEN r <= 1.01 THEN 'match' WHEN r >= 2 THEN 'critical' WHEN r >= 1.25 THEN 'high' ELSE 'medium' END AS verdict FROM r"""
)
def compare_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("case_id").orderBy("document_date", "document_id")
    pairs = documents(spark, sf_dir).select("document_id", F.col("total_amount").alias("a"), F.lag("total_amount").over(w).alias("b"))
    return pairs.filter("b IS NOT NULL").select("document_id", fn.compare_income(F.col("a"), F.col("b")).alias("verdict"))


@register(
    """WITH g AS (SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS group_no FROM conversations)
SELECT conv_id, turn, greatest(group_no, 1) AS group_no FROM g QUALIFY max(group_no) OVER (PARTITION BY conv_id) >= 2"""
)
def split_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page of a file of several with its group: a user turn starts one and the turns after it continue it."""
    pages = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("starts"))
    return operations.page_groups(pages, "conv_id", "turn", "starts")


@register("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS n_match, count(*) FILTER (WHERE toxic = 1) AS n_conflict, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS n_not_checked, source FROM labels JOIN documents USING (doc_id) GROUP BY source")
def family_result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    return found.groupBy("source").agg(F.count_if((q == 1) & (t == 0)).alias("n_match"), F.count_if(t == 1).alias("n_conflict"), F.count_if((q == 0) & (t == 0)).alias("n_not_checked"))


@register(
    """SELECT p_partkey, p_name || '-' || p_size AS name, array_to_string(list_transform(regexp_extract_all(p_name || '-' || p_size, '[0-9]+|[^0-9]+'),
lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(length(regexp_replace(x, '^0+([0-9])', '\\1'))::VARCHAR, 10, '0') || regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END), '') AS sort_key FROM part ORDER BY sort_key, p_partkey"""
)
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts by name and size, runs of digits in the order of their numbers."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("-"), F.col("p_size").cast("string")).alias("name"))
    return parts.withColumn("sort_key", operations.natural_key(F.col("name"))).orderBy("sort_key", "p_partkey")


@register("SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def parse_json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", F.from_json("props", "k string").getField("k").alias("k")).filter("k IS NOT NULL")
