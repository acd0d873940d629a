"""Further registered queries: record upserts, identity and linking, streams over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions import text as fn
from dossier.functions.sql_functions import register_functions
from dossier.operators import identity, operations
from dossier.plans.catalogue import register
from dossier.plans.tables import cases, documents
from dossier.sources import records
from dossier.storage import read_table
from dossier.streaming import monitor


def streamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "orders").schema
    orders = spark.readStream.schema(schema).parquet(f"{sf_dir}/order[s].parquet")
    return orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("document_date"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


@register("SELECT o_custkey AS case_id, o_orderpriority AS document_type, max(o_orderkey) AS document_id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2")
def upsert_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders replace finished ones of the same case and type if they are newer."""
    docs = documents(spark, sf_dir).select("case_id", "document_type", "document_id", "status")
    return records.upsert(docs.filter("status = 'F'"), docs.filter("status <> 'F'"), ["case_id", "document_type"], "document_id")


@register("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_ignore_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.insert_ignore(read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"])


@register("SELECT user_id, CAST(ts AS DATE) AS usage_date, count(*) FILTER (WHERE event_type = 'view') AS n_views, count(*) FILTER (WHERE event_type = 'click') AS n_clicks FROM events GROUP BY 1, 2")
def add_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the month added to stored counters of the first."""
    events = read_table(spark, sf_dir, "events")
    half = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    return records.add_counters(operations.usage_true(events.filter(half)), operations.usage_true(events.filter(~half)), ["user_id", "usage_date"], ["n_views", "n_clicks"])


@register("SELECT c_custkey AS case_id, c_name AS case_name FROM customer WHERE c_nationkey = 7")
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.tenant_scope(cases(spark, sf_dir), 7).select("case_id", "case_name")


@register(
    """WITH h AS (SELECT DISTINCT sha256(text) AS value, doc_id AS case_id FROM documents WHERE text IS NOT NULL)
SELECT 'text' AS signal, value, case_id, min(case_id) OVER (PARTITION BY value) AS first_case, count(*) OVER (PARTITION BY value) AS n_cases, count(*) OVER (PARTITION BY value) > 50 AS common
FROM h QUALIFY n_cases > 1"""
)
def linked_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = read_table(spark, sf_dir, "documents").select(F.lit("text").alias("signal"), F.sha2("text", 256).alias("value"), F.col("doc_id").alias("case_id"))
    return identity.linked_cases(signals)


@register("SELECT d.doc_id, source, coalesce(review_status, 'pending') AS review_status FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'dismissed' END AS review_status FROM labels) USING (doc_id)")
def carry_review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read_table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("dismissed").alias("review_status"))
    return identity.carry_review_decisions(old, read_table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"])


@register("SELECT coalesce(l.doc_id, p.page_id) AS id, CASE WHEN l.doc_id IS NULL THEN 'insert' WHEN p.page_id IS NULL THEN 'delete' ELSE 'keep' END AS action FROM labels l FULL OUTER JOIN pages p ON p.page_id = l.doc_id")
def sync_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    return identity.sync_findings(old, new, ["id"])


@register("SELECT doc_id AS id, quality FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def stored_minus_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    return identity.stored_minus_current(old, new, ["id"])


@register(
    """SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN 'conflict_confirmed' WHEN toxic = 1 THEN 'open' ELSE 'no_issue' END AS resolution FROM labels"""
)
def finding_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic labels as conflicts, those of good quality as accepted ones."""
    kind = F.when(F.col("toxic") == 1, "conflict").otherwise("harmless")
    review = F.when(F.col("quality") == 1, "accepted").otherwise("pending")
    return read_table(spark, sf_dir, "labels").select("doc_id", identity.finding_resolution(kind, review).alias("resolution"))


@register(
    """WITH b AS (SELECT c_nationkey AS family_id, c_custkey AS member_id, min(o_orderdate) AS born FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT family_id, member_id, dense_rank() OVER (PARTITION BY family_id ORDER BY born)::INTEGER AS place FROM b"""
)
def family_birth_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a nation by the date of their first document."""
    born = documents(spark, sf_dir).groupBy("case_id").agg(F.min("document_date").alias("born"))
    members = cases(spark, sf_dir).join(born, "case_id").select(F.col("company_id").alias("family_id"), F.col("case_id").alias("member_id"), "born")
    return identity.birth_order(members).select("family_id", "member_id", "place")


@register(
    """WITH c AS (SELECT o_orderkey AS document_id, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_status, o_orderstatus AS to_status FROM orders)
SELECT *, (from_status || to_status) IN ('OF', 'OP', 'PF', 'OO', 'FF', 'PP') AS valid FROM c WHERE from_status IS NOT NULL"""
)
def case_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("case_id").orderBy("document_date", "document_id")
    changes = documents(spark, sf_dir).select("document_id", F.lag("status").over(w).alias("from_status"), F.col("status").alias("to_status")).filter("from_status IS NOT NULL")
    allowed = spark.sql("SELECT * FROM VALUES ('O','F'), ('O','P'), ('P','F'), ('O','O'), ('F','F'), ('P','P') AS a(from_status, to_status)")
    return operations.case_transition(changes, allowed).select("document_id", "from_status", "to_status", "valid")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length(p) - 2, 1) + 1), lambda i: substr(p, i, 3)))"
_PLAIN = r"' ' || trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


@register(
    f"""WITH l AS (SELECT name, {_GRAMS} AS g FROM (SELECT DISTINCT p_name AS name, {_PLAIN.format("p_name")} AS p FROM part)),
r AS (SELECT issuer, {_GRAMS} AS h FROM (SELECT DISTINCT p_type AS issuer, {_PLAIN.format("p_type")} AS p FROM part)),
s AS (SELECT name, issuer, round(2.0 * len(list_intersect(g, h)) / (len(g) + len(h)), 6)::DOUBLE AS score FROM l CROSS JOIN r),
b AS (SELECT name, issuer, score FROM s WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, issuer) = 1)
SELECT l.name, issuer, score FROM l LEFT JOIN b USING (name)"""
)
def issuer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against the registry of part types."""
    part = read_table(spark, sf_dir, "part")
    return identity.issuer_match(part.select(F.col("p_name").alias("name")), part.select(F.col("p_type").alias("issuer")), 0.5)


@register("SELECT c_custkey, lower(replace(c_name, '#', '-')) AS slug, bit_count(xor(c_custkey, c_nationkey::BIGINT))::INTEGER AS distance, CASE WHEN length(c_name) <= 12 THEN c_name ELSE substr(c_name, 1, 11) || '…' END AS short FROM customer")
def register_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_functions(spark)
    return read_table(spark, sf_dir, "customer").selectExpr("c_custkey", "fn_slug(c_name) AS slug", "fn_hamming(c_custkey, c_nationkey) AS distance", "fn_shorten(c_name, 12) AS short")


@register("SELECT event_type, time_bucket(INTERVAL 15 MINUTES, ts) AS window_start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS longest FROM events GROUP BY 1, 2")
def stream_queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.run_to_table(monitor.queue_metrics(streamed(spark, sf_dir), late="40 days"), "queue", "update", ["event_type", "window_start"])


@register("SELECT user_id, CAST(ts AS DATE) AS usage_date, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases FROM events GROUP BY 1, 2")
def stream_usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.run_to_table(monitor.usage_counters(streamed(spark, sf_dir), late="40 days"), "usage", "update", ["user_id", "usage_date"])


@register("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice, counted once."""
    events = streamed(spark, sf_dir)
    twice = events.union(events)
    return monitor.run_to_table(monitor.dedup(twice).select("event_id", "user_id", "event_type"), "dedup", "append")


@register(
    """WITH RECURSIVE e AS (SELECT user_id, ts, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'error') AS n FROM events WHERE event_type IN ('error', 'purchase')),
s AS (SELECT user_id, n, CASE WHEN failed THEN ts END AS started, CASE WHEN failed THEN 1 ELSE 0 END AS failures FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN NOT failed THEN NULL WHEN failures IN (0, 3) OR ts > started + INTERVAL 24 HOURS THEN ts ELSE started END, CASE WHEN NOT failed THEN 0 WHEN failures IN (0, 3) OR ts > started + INTERVAL 24 HOURS THEN 1 ELSE failures + 1 END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, CAST(failures AS INT) AS failures, started AS first_failure, started + INTERVAL 24 HOURS AS locked_until FROM s WHERE failures = 3"""
)
def stream_login_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as failures and all else as neither; 3 in a day lock."""
    attempts = streamed(spark, sf_dir).filter("event_type IN ('error', 'purchase')").select("user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return monitor.run_to_table(monitor.login_lockout(attempts, 24 * 60, 3, "40 days"), "lockout", "append")


@register(
    """WITH w AS (SELECT event_type, make_timestamp((CAST(floor(epoch(ts) / 900) AS BIGINT) + k) * 900 * 1000000) AS window_end FROM events, (SELECT unnest(range(1, 5)) AS k))
SELECT event_type, window_end, count(*) AS used, greatest(count(*) - 20, 0) AS over FROM w GROUP BY 1, 2"""
)
def stream_rate_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.run_to_table(monitor.rate_usage(streamed(spark, sf_dir), 3600, 20, late="40 days"), "rate", "update", ["event_type", "window_end"])


@register("SELECT o_custkey AS case_id, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_terminal FROM orders GROUP BY 1 HAVING n = n_terminal AND n >= 2")
def stream_case_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.run_to_table(monitor.case_ready(streamed_documents(spark, sf_dir)), "ready")


@register("SELECT o_orderkey AS document_id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 30 DAYS")
def stream_stuck_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stuck = monitor.stuck_documents(streamed_documents(spark, sf_dir), "2000-01-01 00:00:00", 30)
    return monitor.run_to_table(stuck.select("document_id", "status"), "stuck", "append")


@register(
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS came, count(*) FILTER (WHERE event_type = 'purchase') AS ended,
greatest(count(*) FILTER (WHERE event_type = 'click') - count(*) FILTER (WHERE event_type = 'purchase'), 0) AS waiting FROM events GROUP BY 1"""
)
def stream_queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.run_to_table(monitor.queue_depth(streamed(spark, sf_dir)), "depth")


_SOUND = "lower(w)"
for _written, _meant in fn.SAME_NAMES.items():
    _SOUND = f"CASE WHEN lower(w) = '{_written}' THEN '{_meant}' ELSE {_SOUND} END"
for _group, _sound in fn.SOUNDS:
    _SOUND = f"replace({_SOUND}, '{_group}', '{_sound}')"


def _undoubled(expression: str) -> str:
    """The letters that differ from the one before them."""
    return f"array_to_string(list_filter(string_split({expression}, ''), lambda x, i: i = 1 OR x <> string_split({expression}, '')[i - 1]), '')"


@register(
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
k AS (SELECT w, regexp_replace({_SOUND}, 'y$', 'i') AS k FROM w) SELECT w AS word, {_undoubled("k")} AS sound FROM k"""
)
def fn_sound_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound of every distinct word of the documents."""
    words = read_table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    return words.select("word", fn.sound_key(F.col("word")).alias("sound"))
