"""Filter interaction audit by sorted posting lists.

For each part of the documents and each range of row ids there is one sorted list of failing ids for every filter. What
a filter removes after others is the difference of its list and the union of theirs; it depends only on which filters
came before, so 80 differences say all about the 120 orders of five filters. Each is a k-way merge that gallops over
whole runs and gives a size alone. Ranges are counted where their lists lie, and only sizes are shuffled and summed.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.storage import broadcast_if_small, materialize, read_table

FILTERS = "ABCDE"
#: Rows of one id range at most; bounds the lists that a task holds and the size of a row of lists.
RANGE_ROWS = 65_536

_NOT_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_CONTINUATION = bytes(range(0x80, 0xC0))
_MARKS = re.compile(rb"[#$%&*|]")


def own_failures(text: bytes) -> int:
    """Bits 0 to 3: which of the filters A to D the UTF-8 ``text`` fails."""
    words = text.split()
    n = len(words)
    points = len(text.translate(None, _CONTINUATION))
    capitals = len(text.translate(None, _NOT_CAPITALS))
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | bool(_MARKS.search(text)) << 3


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (doc_id, part, mask), one for each row of ``docs``; bit i of mask: the row fails filter i of FILTERS.

    A null text is an empty one, a null part the part of the empty string. A row fails E if a row with a smaller id has
    the same text anywhere in the table; a null id is neither smaller nor larger than another, and rows that repeat an id
    are no copies of each other. Texts are compared by 128 bits of a digest.
    """
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("part", T.StringType()), T.StructField("own", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, digests = [], []
            for t in batch.column(2).cast(pa.binary()):
                text = t.as_py() or b""
                own.append(own_failures(text))
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(digests, pa.binary())], names=out.names)

    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    rows = materialize(plain.mapInArrow(run, out), "failures")
    # copies are put together before the shuffle; only texts that several rows have are looked up
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first")
    marked = rows.join(broadcast_if_small(materialize(first, "copied")), "digest", "left")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return marked.select("doc_id", "part", F.col("own").bitwiseOR(F.shiftleft(again, 4)).alias("mask"))


def posting_lists(failed: DataFrame, n_filters: int = len(FILTERS), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (part, first, n, lists, good, toxic) of the rows (part, mask, good, toxic) of ``failed``: one for each part and
    range of row ids. ``lists`` holds the sorted ids that fail each filter, ``good`` and ``toxic`` those so labelled, and
    n is the number of all rows. Row ids number the rows of a task, so repeated rows have ids of their own.
    """
    ids = T.ArrayType(T.LongType())
    out = T.StructType([T.StructField("part", T.StringType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType()), T.StructField("lists", T.ArrayType(ids)), T.StructField("good", ids), T.StructField("toxic", ids)])
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = {}
        at = first = 0

        def flush() -> pa.RecordBatch:
            rows = [(part, first, n, lists[:n_filters], *lists[n_filters:]) for part, (n, lists) in parts.items()]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=out.names)

        for batch in batches:
            for part, mask, good, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entry = parts.get(part)
                if entry is None:
                    entry = parts[part] = [0, [array("q") for _ in range(n_filters + 2)]]
                entry[0] += 1
                if mask:
                    for i in range(n_filters):
                        if mask >> i & 1:
                            entry[1][i].append(at)
                    if good:
                        entry[1][n_filters].append(at)
                    if toxic:
                        entry[1][n_filters + 1].append(at)
                at += 1
                if at - first >= range_rows:
                    yield flush()
                    first = at
        if parts:
            yield flush()

    return failed.select("part", "mask", "good", "toxic").mapInArrow(run, out)


def gallop(ids: Sequence[int], x: int, at: int) -> int:
    """The first place from ``at`` on whose id is ``x`` or more, by doubling steps."""
    n, step, end = len(ids), 1, at
    while end < n and ids[end] < x:
        at = end + 1
        end += step
        step *= 2
    return bisect_left(ids, x, at, min(end, n))


def difference_size(ids: Sequence[int], others: Sequence[Sequence[int]]) -> int:
    """How many of the sorted ``ids`` are in none of the sorted lists ``others``."""
    live = [[o, 0] for o in others if len(o)]
    at, found, n = 0, 0, len(ids)
    while live and at < n:
        x, nearest = ids[at], None
        for cursor in live:
            place = cursor[1] = gallop(cursor[0], x, cursor[1])
            if place < len(cursor[0]) and (nearest is None or cursor[0][place] < nearest):
                nearest = cursor[0][place]
        if nearest is None:
            break
        upto = gallop(ids, nearest, at)  # a whole run lies before the next id of any other list
        found += upto - at
        at = upto + (upto < n and ids[upto] == nearest)
        live = [c for c in live if c[1] < len(c[0])]
    return found + n - at


def common(a: Sequence[int], b: Sequence[int]) -> array:
    """The ids of both sorted lists."""
    if len(b) < len(a):
        a, b = b, a
    out, at = array("q"), 0
    for x in a:
        at = gallop(b, x, at)
        if at == len(b):
            break
        if b[at] == x:
            out.append(x)
    return out


def cases(n_filters: int) -> list[tuple[int, int]]:
    """(filter, bits of the filters before it): every case that an order can have."""
    rest = lambda f: [i for i in range(n_filters) if i != f]
    return [(f, sum(1 << i for i in before)) for f in range(n_filters) for k in range(n_filters) for before in combinations(rest(f), k)]


def case_sizes(postings: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """Rows (part, filter, before, n, failing, removed, good_lost, toxic_lost), one for each part and case."""
    names = ("part", "filter", "before", "n", "failing", "removed", "good_lost", "toxic_lost")
    all_cases = cases(n_filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, lists, good, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                labelled = [[common(ids, good), common(ids, toxic)] for ids in lists]
                rows = []
                for f, before in all_cases:
                    others = [lists[i] for i in range(n_filters) if before >> i & 1]
                    rows.append((part, f, before, n, len(lists[f]), *(difference_size(ids, others) for ids in (lists[f], *labelled[f]))))
                kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    sizes = postings.select("part", "n", "lists", "good", "toxic").mapInArrow(run, "part string, filter int, before int, n long, failing long, removed long, good_lost long, toxic_lost long")
    return sizes.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in names[3:]))


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """Rows (filter_order, step, filter, before) of all permutations."""
    rows = []
    for order in permutations(range(len(filters))):
        for step, f in enumerate(order):
            rows.append(("".join(filters[i] for i in order), step + 1, f, sum(1 << i for i in order[:step])))
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def interactions(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the rows
    (part, mask, good, toxic) of ``failed``: for every part each step of each order, zeros included.

    Repeated rows count as often as they are there; an empty table gives no rows.
    """
    k = len(filters)
    sizes = materialize(case_sizes(materialize(posting_lists(failed, k), "postings"), k), "sizes")
    weight = F.element_at(F.array(*(F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k))), F.bit_count("before") + 1)
    alone = F.when(F.bit_count("before") == k - 1, F.col("removed"))  # all other filters come before
    totals = sizes.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"), F.max(alone).alias("unique_fails"))
    steps = sizes.join(F.broadcast(orders(failed.sparkSession, filters)), ["filter", "before"])  # k! * k rows, whatever the input
    # what remains after a step: what a filter removes depends on those before it alone, so each prefix of an order is a chain
    kept = F.col("n") - F.sum("removed").over(_prefix())
    return (
        steps.withColumn("kept", kept)
        .join(totals, ["part", "filter"])
        .select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def _prefix():  # noqa: ANN202
    from pyspark.sql import Window as W

    return W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, 0)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The interactions of the five filters over ``docs``; see ``failures`` for nulls and copies and ``interactions`` for the
    rows. A document is good or toxic if any row of ``labels`` says so; null ids have no label. Other columns are not read.
    """
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    said = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).filter("good = 1 OR toxic = 1")
    failed = failures(docs, id_col, text_col, part_col)
    joined = failed.join(broadcast_if_small(materialize(said, "labelled")), F.col("doc_id") == F.col("id"), "left")
    return interactions(joined.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
counted AS (
  SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
said AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(counted.doc_id > first_id, false)] AS f
  FROM counted LEFT JOIN said USING (doc_id)),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) AS t(letter, i)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, step, o[step] AS fi, o[1:step - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
classes AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY 1, 2),
found AS (
  SELECT part, filter_order, step, fi, n, good, toxic, f[fi] AS fails, coalesce(list_bool_or(list_transform(before, lambda i: f[i])), false) AS gone,
    len(list_filter(f, lambda x: x)) = 1 AS by_itself FROM classes, steps),
summed AS (
  SELECT part, filter_order, step, fi, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE gone AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails AND by_itself), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
  FROM found GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, fi) AS BIGINT) AS shapley FROM summed
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
