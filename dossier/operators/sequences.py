"""Windows anchored at recorded events, and how far two orders of the same items agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dossier.storage import Scratch, broadcast_if_small

#: Rows that one block of ranks holds.
BLOCK_ROWS = 65_536
#: Blocks of ranks of one order at most.
MOST_BLOCKS = 2048


def _following(events: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Rows (keys, at, next) of the distinct (keys, at in microseconds): the first later time that is more than ``window``
    later, null if there is none. Times are dealt into blocks of the window's length, so no key is one task."""
    block = F.floor(F.col("t") / max(window, 1))
    times = events.select(*keys, F.col("at").alias("t"), F.col("at").alias("event"), F.lit(None).cast("long").alias("probe"))
    probes = events.select(*keys, (F.col("at") + window).alias("t"), F.lit(None).cast("long").alias("event"), F.col("at").alias("probe"))
    both = times.union(probes).withColumn("block", block)
    # going back in time, the last event met is the next one; at one time the probe comes first, so an event at its very end isn't next
    back = W.partitionBy(*keys, "block").orderBy(F.desc("t"), F.col("event").isNotNull())
    own = both.withColumn("found", F.last("event", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)))
    firsts = events.withColumn("t", F.col("at")).groupBy(*keys, block.alias("event_block")).agg(F.min("at").alias("first"))
    # blocks of one key that have events, and the blocks that probes fall into, in order: a row for each block
    blocks = own.filter("probe IS NOT NULL").select(*keys, "block").distinct()
    blocks = blocks.withColumn("first", F.lit(None).cast("long")).union(firsts.select(*keys, F.col("event_block").alias("block"), "first"))
    blocks = blocks.groupBy(*keys, "block").agg(F.max("first").alias("first"))
    later = W.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    later = blocks.withColumn("later", F.last("first", ignorenulls=True).over(later)).select(*keys, "block", "later")
    found = own.filter("probe IS NOT NULL").join(later, [*keys, "block"], "left")
    return found.select(*keys, F.col("probe").alias("at"), F.coalesce("found", "later").alias("next"))


def access_dedup(events: DataFrame, window_s: float, keys: tuple[str, ...] = ("user_id", "company_id", "path", "method"), ts: str = "ts", reads: str = "GET") -> DataFrame:
    """The rows of ``events`` that are recorded: all that don't read, and of reads with equal ``keys`` the first, then each one
    more than ``window_s`` seconds after the last recorded one. Of reads at one time one row is recorded.

    Which reads are recorded hangs on those recorded before. Each time points to the next that would be recorded after it;
    pointers are doubled each round, and the times that a key's first one reaches are recorded. So a key of n reads takes
    the logarithm of n rounds of joins, and none is worked off by one task. Null keys are equal; null times aren't recorded.
    """
    window = round(window_s * 1e6)
    keys = list(keys)
    number = "__at"
    timed = events.withColumn(number, F.unix_micros(F.col(ts).cast("timestamp")))
    read = timed.filter((F.col("method") == reads) & F.col(number).isNotNull())
    if window <= 0:
        return events.filter(F.col(ts).isNotNull())
    code = F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys), *(F.col(k).isNull() for k in keys))
    scratch = Scratch(events.sparkSession)
    times = scratch.table(read.select(code.alias("key"), F.col(number).alias("at")).distinct(), "times")
    jump = scratch.table(_following(times, ["key"], window).filter("next IS NOT NULL"), "jump0")
    reached = scratch.table(times.groupBy("key").agg(F.min("at").alias("at")), "reached0")
    n = 0
    while not jump.isEmpty():
        step = reached.join(jump, ["key", "at"]).select("key", F.col("next").alias("at"))
        reached = scratch.table(reached.union(step), f"reached{n + 1}")
        further = jump.select("key", F.col("at").alias("next"), F.col("next").alias("then"))
        jump = scratch.table(jump.join(further, ["key", "next"]).select("key", "at", F.col("then").alias("next")), f"jump{n + 1}")
        scratch.drop(f"reached{n}", f"jump{n}")
        n += 1
    key = "__key"
    recorded = read.withColumn(key, code).join(reached.select(F.col("key").alias(key), F.col("at").alias(number)), [key, number], "left_semi").dropDuplicates([key, number])
    return recorded.select(*events.columns).unionByName(events.filter(F.col(ts).isNotNull() & ~F.coalesce(F.col("method") == reads, F.lit(False))))


def access_dedup_stream(events: DataFrame, window_s: float, keys: tuple[str, ...] = ("user_id", "company_id", "path", "method"), late: str = "10 minutes") -> DataFrame:
    """Rows (keys, ts) of a stream of reads that are recorded. State is the last recorded time of each key, which goes when the
    watermark passes the end of its window; what comes later than the watermark isn't recorded."""
    names = list(keys)
    out = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in names) + ", ts timestamp"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(x for pdf in batches for x in pdf["ts"]):
            if last is None or t.timestamp() - last > window_s:
                last = t.timestamp()
                kept.append(t)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        if kept:
            yield pd.DataFrame({**dict(zip(names, key, strict=True)), "ts": kept})

    return events.withWatermark("ts", late).groupBy(*names).applyInPandasWithState(step, out, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def ranked(df: DataFrame, order: list[Column], rank: str, scratch: Scratch) -> DataFrame:
    """``df`` with the number of each row (a long from 0) in ``order``: rows are dealt by ranges and numbered within them, and
    only the sizes of the ranges go through a window."""
    parts = max(1, -(-df.count() // BLOCK_ROWS))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = scratch.table(placed, "placed")
    part = F.shiftright("__id", 33)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = placed.groupBy(part.alias("part")).count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).select("part", "start")
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(broadcast_if_small(scratch.table(starts, "starts")), F.shiftright("__id", 33) == F.col("part")).withColumn(rank, F.col("start") + within).drop("__id", "part", "start")


def inversions(values: np.ndarray) -> int:
    """Pairs of places i < j with values[i] > values[j]."""
    if len(values) <= 64:
        return int(np.triu(values[:, None] > values[None, :], 1).sum())
    half = len(values) // 2
    left, right = values[:half], values[half:]
    across = half * len(right) - int(np.searchsorted(np.sort(left), right, side="right").sum())
    return inversions(left) + inversions(right) + across


def order_agreement(items: DataFrame, first: list[Column], second: list[Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row (n, discordant, tau): Kendall's rank agreement of the two orders of the rows of ``items``, rounded to three
    places; 1 for fewer than two rows. Both orders must be total.

    Discordant pairs are counted in three parts, none of which makes a pair: pairs of one block of second ranks by merging
    that block in first order, those of one block of first ranks by merging its block numbers, and all others from the
    counts of the blocks by blocks, summed along both sides. Blocks have ``block_rows`` rows, or more where there would be
    over MOST_BLOCKS: the counts grow with the square of the blocks, and a block is held by one task.
    """
    scratch = Scratch(items.sparkSession, clean=True)
    names = [[f"{side}{i}" for i in range(len(order))] for side, order in (("a", first), ("b", second))]
    narrow = items.select(*(c.alias(n) for order, own in zip((first, second), names, strict=True) for c, n in zip(order, own, strict=True)))
    by_first = ranked(narrow, [F.col(c) for c in names[0]], "ra", scratch).select("ra", *names[1])
    both = ranked(by_first, [F.col(c) for c in names[1]], "rb", scratch).select("ra", "rb")
    n = items.count()
    block_rows = max(block_rows, -(-n // MOST_BLOCKS))
    both = scratch.table(both.select("ra", "rb", F.floor(F.col("ra") / block_rows).alias("ba"), F.floor(F.col("rb") / block_rows).alias("bb")), "ranks")
    scratch.drop("placed", "starts")

    def merged(order: str, value: str):  # noqa: ANN202
        def run(table: pa.Table) -> pa.Table:
            at = np.argsort(table.column(order).to_numpy(), kind="stable")
            return pa.table({"n": pa.array([inversions(table.column(value).to_numpy()[at])], pa.int64())})

        return run

    inside = both.groupBy("bb").applyInArrow(merged("ra", "rb"), "n long").union(both.groupBy("ba").applyInArrow(merged("ra", "bb"), "n long"))
    cells = scratch.table(both.groupBy("ba", "bb").count(), "cells")
    above = W.partitionBy("bb").orderBy("ba").rowsBetween(W.unboundedPreceding, -1)
    beside = W.partitionBy("ba").orderBy(F.desc("bb")).rowsBetween(W.unboundedPreceding, -1)
    # every block of first ranks with every block of second ranks, so that earlier counts are carried along
    grid = cells.select("ba").distinct().withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // block_rows) - 1))).cast("array<long>")))
    full = grid.join(cells, ["ba", "bb"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    earlier = full.withColumn("earlier", F.coalesce(F.sum("count").over(above), F.lit(0)))
    across = earlier.withColumn("larger", F.coalesce(F.sum("earlier").over(beside), F.lit(0))).select((F.col("count") * F.col("larger")).alias("n"))
    total = inside.union(across).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("discordant"))
    pairs = n * (n - 1) // 2
    tau = F.round((pairs - 2 * F.col("discordant")) / F.lit(float(pairs or 1)), 3) if pairs else F.lit(1.0)
    return total.select(F.lit(n).cast("long").alias("n"), "discordant", tau.alias("tau"))
