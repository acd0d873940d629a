"""Streaming forms of the operations analytics, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dossier.storage import new_path


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files under ``path`` (a folder, or a pattern)."""
    return spark.readStream.schema(schema).parquet(path)


def queue_metrics(events: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Per event type and window: number, mean and maximum. State is one row for each open window."""
    w = F.window("ts", f"{minutes} minutes")
    found = events.withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("longest"))
    return found.select("event_type", F.col("w.start").alias("window_start"), "n", F.round("mean", 6).alias("mean"), "longest")


def rate_usage(events: DataFrame, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """Windows of ``seconds``, sliding by a quarter of it, with the events of each type and how many exceed the limit."""
    w = F.window("ts", f"{seconds} seconds", f"{max(1, seconds // 4)} seconds")
    found = events.withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("used"))
    return found.select("event_type", F.col("w.end").alias("window_end"), "used", F.greatest(F.col("used") - limit, F.lit(0)).alias("over"))


def usage_counters(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily counters of each user, corrected as events come in."""
    day = F.window("ts", "1 day")
    found = events.withWatermark("ts", late).groupBy("user_id", day.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("n_purchases"))
    return found.select("user_id", F.to_date("w.start").alias("usage_date"), "n", "n_purchases")


def dedup(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Redelivered events counted once; a key is remembered as long as the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


LOCKOUT = "user_id long, failures int, first_failure timestamp, locked_until timestamp"
LOCK_STATE = "started double, failures int"


def anchored_failures(rows: list[tuple[float, bool]], started: float, failures: int, window: float, limit: int) -> tuple[list[tuple[float, int]], float, int]:
    """Locks as (first failure, failures) of (time, failed) in time order, and the state after them.

    A window is anchored at its first failure, a success clears it, and the failure that reaches the limit locks and
    begins anew.
    """
    locks = []
    for at, failed in rows:
        if not failed:
            started, failures = 0.0, 0
            continue
        if not failures or at - started > window:
            started, failures = at, 0
        failures += 1
        if failures == limit:
            locks.append((started, failures))
            started, failures = 0.0, 0
    return locks, started, failures


def login_lockout(attempts: DataFrame, minutes: int = 15, limit: int = 5, late: str = "1 hour") -> DataFrame:
    """Locks of users by failures (user_id, ts, failed). State is one number and one time for each user."""
    window = minutes * 60.0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        started, failures = state.get if state.exists else (0.0, 0)
        rows = sorted((t.timestamp(), bool(f)) for pdf in batches for t, f in zip(pdf["ts"], pdf["failed"], strict=True))
        locks, started, failures = anchored_failures(rows, started, failures, window, limit)
        state.update((started, failures))
        state.setTimeoutTimestamp(max(int((rows[-1][0] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        if locks:
            first = [pd.Timestamp(round(a * 1e6), unit="us") for a, _ in locks]
            yield pd.DataFrame({"user_id": key[0], "failures": [n for _, n in locks], "first_failure": first, "locked_until": [a + pd.Timedelta(minutes=minutes) for a in first]})

    return attempts.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, LOCKOUT, LOCK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, label: str, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is now into a table in the shared folder, and read that.

    In update mode each batch writes the rows that it has changed, and the reader takes the latest of each of ``keys``; the
    stream's state then holds no more than the watermark asks for. Complete mode keeps and rewrites the whole result: it
    is for results of few rows. A batch writes its own subfolder, so one that comes twice leaves one result.
    """
    spark = stream.sparkSession
    path = new_path(spark, label)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={epoch}")

    spark.createDataFrame([], stream.schema).write.parquet(path if mode == "complete" else f"{path}/batch=-1")
    finish(stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, f"{label}-state")).trigger(availableNow=True).foreachBatch(put).start())
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(path)
    rows = spark.read.option("basePath", path).schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/batch=*")
    if mode == "update":
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("last_row")).select("last_row.*")
    return rows.select(*stream.columns)


def finish(query: StreamingQuery) -> None:
    """Wait for a stream over what there is now, however long it takes."""
    query.awaitTermination()
    if error := query.exception():
        raise error


def case_ready(documents: DataFrame, least: int = 2) -> DataFrame:
    """Cases of which every document that has come is terminal, and there are ``least``; state is two numbers a case."""
    n = documents.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "F").alias("n_terminal"))
    return n.filter((F.col("n") == F.col("n_terminal")) & (F.col("n") >= least))


def stuck_documents(documents: DataFrame, now: str, days: int) -> DataFrame:
    """Documents that are not terminal and older than ``days`` at ``now``; no state."""
    return documents.filter((F.col("status") != "F") & (F.col("document_date") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")))


def queue_depth(events: DataFrame) -> DataFrame:
    """Per user the tasks that came and those that ended, and how many wait; state is two numbers a user."""
    n = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("came"), F.count_if(F.col("event_type") == "purchase").alias("ended"))
    return n.withColumn("waiting", F.greatest(F.col("came") - F.col("ended"), F.lit(0)))


def queue_alert(waiting: DataFrame, now: str, seconds: int, queue: str = "queue", since: str = "enqueued") -> DataFrame:
    """Queues whose oldest waiting task is older than ``seconds`` at ``now``; state is one time for each queue."""
    oldest = waiting.groupBy(queue).agg(F.min(since).alias("oldest"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("oldest")
    return oldest.withColumn("age", age).filter(F.col("age") > seconds)


def token_cutoff(events: DataFrame, cutoffs: DataFrame, issued: str = "ts") -> DataFrame:
    """Events with a token that was issued before the latest cut-off (user_id, cutoff) of its user. The stream meets a
    table that is read anew with each batch; it keeps no state."""
    latest = cutoffs.groupBy("user_id").agg(F.max("cutoff").alias("cutoff"))
    return events.join(latest, "user_id").filter(F.col(issued) < F.col("cutoff"))


def run_batches(stream: DataFrame, label: str, put: Callable[[DataFrame, int], None]) -> None:
    """Give each micro-batch of what there is now to ``put``, which must do the same again if a batch comes twice."""
    finish(stream.writeStream.option("checkpointLocation", new_path(stream.sparkSession, f"{label}-state")).trigger(availableNow=True).foreachBatch(put).start())


def rescore(finished: DataFrame, assess: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Assessments (case_id, fingerprint, more: ``schema``) that a stream of finished checks asks for.

    Each batch names its distinct cases to ``assess``; an assessment whose evidence is that of a stored one is not
    stored again. A batch writes its own subfolder, so one that comes twice leaves one result.
    """
    spark = finished.sparkSession
    path = new_path(spark, "assessments")

    def put(batch: DataFrame, epoch: int) -> None:
        wanted = assess(batch.select("case_id").distinct())
        stored = spark.read.option("basePath", path).schema(f"{schema}, batch long").parquet(f"{path}/batch=*").filter(F.col("batch") < epoch)
        wanted = wanted.join(stored.select("case_id", "fingerprint"), ["case_id", "fingerprint"], "left_anti")
        wanted.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    spark.createDataFrame([], schema).write.parquet(f"{path}/batch=-1")
    run_batches(finished, "rescore", put)
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def late_evidence(results: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """The newest result of each key of a stream in which later evidence changes earlier results.

    A batch is reduced to one row for each of its keys and written to its own subfolder; the reader keeps the newest
    of all batches, so what comes late or twice changes nothing else.
    """
    spark, columns = results.sparkSession, results.columns
    path = new_path(spark, "late")

    def last(rows: DataFrame) -> DataFrame:
        one = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(newest)).alias("last_row"))
        return one.select(*(F.col("last_row").getField(c).alias(c) for c in columns))

    def put(batch: DataFrame, epoch: int) -> None:
        last(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    spark.createDataFrame([], results.schema).write.parquet(f"{path}/batch=-1")
    run_batches(results, "late", put)
    return last(spark.read.schema(results.schema).parquet(f"{path}/batch=*").select(*columns))
