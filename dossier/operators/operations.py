"""Operations analytics: case queues, audit search, usage, queue monitoring, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def document_progress(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (case_id, total, finished, started) with zeros for cases without documents."""
    n = documents.groupBy("case_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "F").alias("finished"), F.count_if(F.col("status") == "P").alias("started"))
    return cases.select("case_id").join(n, "case_id", "left").fillna(0, ["total", "finished", "started"])


def case_queue(cases: DataFrame, documents: DataFrame, status: str | None = None) -> DataFrame:
    """Cases with their document counts; those without open documents are hidden unless ``status`` asks for all."""
    n = documents.groupBy("case_id").agg(F.count("*").alias("n_documents"), F.count_if(F.col("status") == "O").alias("n_open"), F.max("document_date").alias("newest"))
    found = cases.join(n, "case_id", "left").fillna(0, ["n_documents", "n_open"])
    return found if status == "all" else found.filter("n_open > 0")


def retention_due(documents: DataFrame, cutoff: str) -> DataFrame:
    """Documents of a terminal status from before ``cutoff``."""
    return documents.filter((F.col("document_date") < F.lit(cutoff).cast("timestamp")) & (F.col("status") == "F"))


def oldest_batch(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def audit_search(events: DataFrame, actors: DataFrame, text: str | None = None, kinds: tuple[str, ...] = (), since: str | None = None) -> DataFrame:
    """Events with their actor's name, by kind, time and a substring of the name, whichever is given."""
    found = events
    if kinds:
        found = found.filter(F.col("event_type").isin(*kinds))
    if since:
        found = found.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    found = found.join(actors, "user_id", "left")
    return found.filter(F.lower("actor").contains(text.lower())) if text else found


#: Windows over one user's events work on blocks of an hour; what joins the blocks is one row for each of them.
BLOCK_SECONDS = 3600


def time_block(ts: Column, seconds: int = BLOCK_SECONDS) -> Column:
    """The number of the block of time of ``ts``; events without a time are in a block before all others."""
    return F.coalesce(F.floor(F.unix_timestamp(ts) / seconds), F.lit(-(1 << 40)).cast("long"))


def audit_excerpt(events: DataFrame, first: int) -> DataFrame:
    """The first events of each user and how many more there are.

    Only the first few of a user leave a partition, and the counts are put together before they are shuffled.
    """
    top = events.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))).filter(F.col("place") <= first)
    n = events.groupBy(F.col("user_id").alias("__user")).agg(F.count("*").alias("__n"))
    return top.join(n, F.col("user_id").eqNullSafe(F.col("__user"))).withColumn("truncated", F.greatest(F.col("__n") - first, F.lit(0))).drop("__user", "__n")


def usage_true(events: DataFrame) -> DataFrame:
    """Daily counters (user_id, usage_date, n_views, n_clicks, n_purchases, amount) in UTC days."""
    day = F.to_date("ts")
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    amount = F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double")
    return events.groupBy("user_id", day.alias("usage_date")).agg(count("view").alias("n_views"), count("click").alias("n_clicks"), count("purchase").alias("n_purchases"), amount.alias("amount"))


def usage_reconcile(stored: DataFrame, true: DataFrame, counters: list[str]) -> DataFrame:
    """Rows of keys (user_id, usage_date) where any counter differs, with was and now of each; a missing row counts 0."""
    s = stored.select("user_id", "usage_date", *(F.col(c).alias(f"{c}_was") for c in counters))
    t = true.select("user_id", "usage_date", *(F.col(c).alias(f"{c}_now") for c in counters))
    both = s.join(t, ["user_id", "usage_date"], "full").fillna(0)
    return both.filter(" OR ".join(f"{c}_was <> {c}_now" for c in counters))


def usage_totals(daily: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Sums per key and a grand total in a row with a null key."""
    return daily.rollup(key).agg(*(F.sum(c).alias(c) for c in counters))


def queue_metrics(events: DataFrame, minutes: int = 15) -> DataFrame:
    """Per event type and window of time: number, mean, interpolated 95th percentile and maximum of the value."""
    window = F.window("ts", f"{minutes} minutes")
    found = events.groupBy("event_type", window.alias("w")).agg(F.count("*").alias("n"), F.percentile("value", 0.95).alias("p95"), F.max("value").alias("longest"))
    return found.select("event_type", F.col("w.start").alias("window_start"), "n", F.round("p95", 6).alias("p95"), "longest")


def peak_in_window(events: DataFrame, seconds: int) -> DataFrame:
    """Most events of a type in any window of ``seconds`` that ends with an event.

    Events are counted by second first. Time is cut into blocks of 16 windows, and the last window of a block is also
    given to the next block, so each block is a small partition and a type with a third of all events is dealt out.
    """
    size = 16 * seconds
    by_second = events.groupBy("event_type", F.unix_timestamp("ts").alias("second")).agg(F.count("*").alias("n"))
    block = F.floor(F.col("second") / size)
    late = F.col("second") - block * size >= size - seconds
    dealt = by_second.select("event_type", "second", "n", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"))
    w = W.partitionBy("event_type", "block").orderBy("second").rangeBetween(-seconds + 1, 0)
    sums = dealt.select("event_type", (F.floor(F.col("second") / size) == F.col("block")).alias("own"), F.sum("n").over(w).alias("n"))
    return sums.filter("own").groupBy("event_type").agg(F.max("n").alias("peak"))


def fair_share_priority(events: DataFrame, bucket: int = 5, lowest: int = 9) -> DataFrame:
    """Rows (event_id, user_id, outstanding, priority): tasks published less those finished before each publication.

    Sums run within blocks of time; what is outstanding when a block begins is the sum of the blocks before it. So the
    events of a user who has very many are dealt out.
    """
    delta = F.when(F.col("event_type").isin("signup", "click"), 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    steps = events.select("event_id", "user_id", "event_type", "ts", delta.alias("delta"), time_block(F.col("ts")).alias("block"))
    sums = steps.groupBy("user_id", "block").agg(F.sum("delta").alias("delta"))
    before = F.sum("delta").over(W.partitionBy("user_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    begun = sums.select(F.col("user_id").alias("__user"), F.col("block").alias("__block"), F.coalesce(before, F.lit(0)).alias("begun"))
    within = F.sum("delta").over(W.partitionBy("user_id", "block").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1))
    joined = steps.withColumn("within", within).filter("event_type = 'click'").join(begun, F.col("user_id").eqNullSafe(F.col("__user")) & (F.col("block") == F.col("__block")))
    found = joined.select("event_id", "user_id", F.greatest(F.col("begun") + F.coalesce("within", F.lit(0)), F.lit(0)).alias("outstanding"))
    return found.select("*", F.least(F.lit(lowest), F.floor(F.col("outstanding") / bucket)).cast("long").alias("priority"))


def sessions_by_gap(events: DataFrame, seconds: int) -> DataFrame:
    """Rows (user_id, session_no, started, n_events): a gap of over ``seconds`` begins a new session.

    Events are cut into sessions within blocks of time first; only these pieces, few of which a user can have, meet
    in a window over the whole user.
    """
    inside = W.partitionBy("user_id", "block").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(inside))
    marked = events.select("user_id", "event_id", "ts", time_block(F.col("ts")).alias("block")).withColumn("fresh", F.coalesce(gap > seconds, F.lit(True)).cast("int"))
    numbered = marked.withColumn("piece", F.sum("fresh").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    pieces = numbered.groupBy("user_id", "block", "piece").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events"))
    whole = W.partitionBy("user_id").orderBy("block", "piece")
    apart = F.unix_timestamp("started") - F.unix_timestamp(F.lag("ended").over(whole))
    joined = pieces.withColumn("fresh", F.coalesce(apart > seconds, F.lit(True)).cast("int")).withColumn("session_no", F.sum("fresh").over(whole.rowsBetween(W.unboundedPreceding, 0)))
    return joined.groupBy("user_id", "session_no").agg(F.min("started").alias("started"), F.sum("n_events").alias("n_events"))


def check_coverage(cases: DataFrame, checks: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows (check_type, n_ran, n_flagged, n_missing): of all cases, how many have a check of each kind."""
    n = cases.select("case_id").distinct().agg(F.count("*").alias("n_cases")).select("n_cases").scalar()
    ran = checks.groupBy("check_type").agg(F.countDistinct("case_id").alias("n_ran"), F.count_if(F.col("flagged")).alias("n_flagged"))
    return kinds.join(ran, "check_type", "left").fillna(0, ["n_ran", "n_flagged"]).withColumn("n_missing", n - F.col("n_ran"))


def case_transition(changes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Each change (key, from_status, to_status) with valid true or false by the table of allowed transitions."""
    return changes.join(allowed.withColumn("valid", F.lit(True)), ["from_status", "to_status"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def natural_key(text: Column) -> Column:
    """A key that sorts "case-2" before "case-10": each run of digits is led by its length without leading zeros, so runs
    of any length are in the order of their numbers. Runs that differ in leading zeros alone have one key."""
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def key(run: Column) -> Column:
        number = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(number).cast("string"), 10, "0"), number)).otherwise(run)

    return F.array_join(F.transform(runs, key), "")


def page_groups(pages: DataFrame, file: str, page: str, starts: str) -> DataFrame:
    """Rows (file, page, group_no) of the files that have several groups of pages; a page that ``starts`` begins one, and
    pages before the first such page belong to it. The pages of one file are numbered in one task."""
    up_to = W.partitionBy(file).orderBy(page)
    numbered = pages.select(file, page, F.sum(F.coalesce(F.col(starts), F.lit(False)).cast("int")).over(up_to).cast("long").alias("group_no"))
    several = numbered.withColumn("__most", F.max("group_no").over(W.partitionBy(file))).filter(F.col("__most") >= 2)
    return several.select(file, page, F.greatest("group_no", F.lit(1)).alias("group_no"))
