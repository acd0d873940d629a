"""Queries of anchored windows and rank agreement over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import sequences
from dossier.plans.catalogue import register
from dossier.plans.more import streamed
from dossier.storage import read_table
from dossier.streaming import monitor

_ACCESS = "user_id % 5 AS user_id, event_type AS path, CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method"


@register(
    """WITH RECURSIVE a AS (SELECT event_id, ts, user_id % 5 AS user_id, event_type AS path, CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method FROM events),
r AS (SELECT user_id, path, min(ts) AS ts FROM a WHERE method = 'GET' GROUP BY 1, 2
  UNION ALL SELECT r.user_id, r.path, (SELECT min(a.ts) FROM a WHERE a.user_id = r.user_id AND a.path = r.path AND a.ts > r.ts + INTERVAL 6 HOURS) AS ts FROM r WHERE r.ts IS NOT NULL)
SELECT ts, user_id, path, method FROM a WHERE method = 'POST' UNION ALL SELECT ts, user_id, path, 'GET' FROM r WHERE ts IS NOT NULL"""
)
def access_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of the same thing by five admins, recorded once in six hours from the last recorded one; purchases change something."""
    events = read_table(spark, sf_dir, "events").selectExpr("ts", "CAST(NULL AS LONG) AS company_id", *_ACCESS.split(", "))
    return sequences.access_dedup(events, 6 * 3600).select("ts", "user_id", "path", "method")


@register(
    """WITH RECURSIVE a AS (SELECT ts, user_id % 5 AS user_id, event_type AS path FROM events WHERE event_type <> 'purchase'),
r AS (SELECT user_id, path, min(ts) AS ts FROM a GROUP BY 1, 2
  UNION ALL SELECT r.user_id, r.path, (SELECT min(a.ts) FROM a WHERE a.user_id = r.user_id AND a.path = r.path AND a.ts > r.ts + INTERVAL 6 HOURS) AS ts FROM r WHERE r.ts IS NOT NULL)
SELECT user_id, path, ts FROM r WHERE ts IS NOT NULL"""
)
def stream_access_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streamed(spark, sf_dir).selectExpr("ts", "user_id % 5 AS user_id", "event_type AS path").filter("path <> 'purchase'")
    return monitor.run_to_table(sequences.access_dedup_stream(events, 6 * 3600, ("user_id", "path"), "40 days"), "access", "append")


@register(
    """WITH r AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS b FROM orders),
d AS (SELECT count(*) AS discordant FROM r x JOIN r y ON x.a < y.a AND x.b > y.b), n AS (SELECT count(*) AS n FROM r)
SELECT n, discordant, round((n * (n - 1) / 2 - 2 * discordant)::DOUBLE / (n * (n - 1) / 2), 3) AS tau FROM d, n"""
)
def order_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by date against orders by price, in blocks of a thousand."""
    return sequences.order_agreement(read_table(spark, sf_dir, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], [F.col("o_totalprice"), F.col("o_orderkey")], 1000)
