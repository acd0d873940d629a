"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that begin with ">" marks are quoted, as deep as they have marks. Neighbouring lines of one depth are a passage.
Passages are normalised and hashed; within a conversation a quoted passage is joined to the earliest message that wrote
it (its own, unquoted text has a passage of that hash), which is one row for each conversation and hash, so neither a
passage that very many messages quote nor one that very many wrote makes pairs. A message replies to the latest
message it quotes at the least depth, else to the message before it. Threads are the trees of quotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.storage import Scratch, materialize, read_table

MARKS = r"^[\x20\t]*+((?:>[\x20\t]?+)++)"
#: Turns of one conversation that a task orders together, on average.
BLOCK = 65_536
#: Signs within a passage that normalising takes for spaces anyway; they mark where one begins and its depth ends.
BEGIN, DEPTH_END = "\x01", "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quote_depth(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(F.regexp_replace(marks, "[^>]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, MARKS, "")


def normal_passage(text: Column) -> Column:
    """A-Z in lower case, every run of other than letters and digits one space, none around."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+", " "))


def lines_of(text: Column) -> Column:
    """Structs (depth, text) of a message's lines."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(quote_depth(x).alias("depth"), unquoted(x).alias("text")))


def own_text(lines: Column) -> Column:
    """A message without its quoted lines."""
    return F.trim(F.array_join(F.transform(F.filter(lines, lambda x: x["depth"] == 0), lambda x: x["text"]), "\n"))


def passages_of(lines: Column) -> Column:
    """Structs (depth, text) of a message's passages: neighbouring lines of one depth; a blank line ends one.

    Every line is marked by what is before it and the marked lines are joined and cut again, so the work is in
    proportion to the message.
    """

    def marked(x: Column, before: Column) -> Column:
        text = F.translate(x["text"], BEGIN + DEPTH_END, "  ")
        fresh = before.isNull() | (before["depth"] != x["depth"]) | (F.trim(before["text"]) == "") | (F.trim(x["text"]) == "")
        return F.when(fresh, F.concat(F.lit(BEGIN), x["depth"].cast("string"), F.lit(DEPTH_END), text)).otherwise(F.concat(F.lit("\n"), text))

    nothing = F.array(F.lit(None).cast("struct<depth:int,text:string>"))
    joined = F.array_join(F.zip_with(lines, F.concat(nothing, F.slice(lines, F.lit(1), F.size(lines) - 1)), marked), "")
    pieces = F.filter(F.split(joined, BEGIN), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(F.substring_index(p, DEPTH_END, 1).cast("int").alias("depth"), F.substring_index(p, DEPTH_END, -1).alias("text")))


def link(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, reply_to) of the messages (conv_id, turn, text) that quote an earlier message."""
    lines = messages.select("conv_id", "turn", lines_of(F.col("text")).alias("lines"))
    passages = lines.select("conv_id", "turn", F.explode(passages_of(F.col("lines"))).alias("p")).select("conv_id", "turn", F.col("p.depth").alias("depth"), normal_passage(F.col("p.text")).alias("form"))
    hashed = passages.filter("form != ''").select("conv_id", "turn", "depth", F.sha2("form", 256).alias("hash"))
    wrote = hashed.filter("depth = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quotes = hashed.filter("depth > 0").groupBy("conv_id", "turn", "hash").agg(F.min("depth").alias("depth"))
    found = quotes.join(materialize(wrote, "originals"), ["conv_id", "hash"]).filter("origin < turn")
    return found.groupBy("conv_id", "turn").agg(F.min(F.struct("depth", (-F.col("origin")).alias("origin"))).alias("b")).select("conv_id", "turn", (-F.col("b.origin")).alias("reply_to"))


def in_order(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, quoted, first, before, place, head, head_place) of the distinct turns (conv_id, turn, quoted).

    ``before`` is the turn before, ``place`` counts a conversation's turns from 1, ``head`` is the latest turn up to this
    one that quotes another, else the conversation's first. Turns are dealt by ranges of (conversation, turn) of about
    ``BLOCK`` turns each, whatever their distances, and what is known at the end of a range is carried to the next; so a hot
    conversation is dealt out, and only its ranges meet in one task.
    """
    turns = materialize(turns, "dealt")
    parts = max(1, -(-turns.count() // BLOCK))
    dealt = turns.repartitionByRange(parts, "conv_id", "turn").select("conv_id", "turn", "quoted", F.spark_partition_id().alias("block"))
    dealt = materialize(dealt, "ranges")
    of_block = W.partitionBy("conv_id", "block").orderBy("turn")
    inside = dealt.withColumns({"at": F.row_number().over(of_block), "before": F.lag("turn").over(of_block)})
    is_head = F.col("quoted").isNotNull()
    inside = materialize(inside.withColumn("head", F.last(F.when(is_head, F.struct("turn", "at")), ignorenulls=True).over(of_block)), "turns")
    blocks = inside.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("last"), F.max(F.when(is_head, F.struct("turn", "at"))).alias("head"))
    by_block = W.partitionBy("conv_id").orderBy("block")
    earlier = by_block.rowsBetween(W.unboundedPreceding, -1)
    counted = blocks.select("conv_id", "block", F.min("low").over(W.partitionBy("conv_id")).alias("first"), "last", "head", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("more"))
    counted = counted.withColumn("head", F.when(F.col("head").isNotNull(), F.struct(F.col("head.turn").alias("turn"), (F.col("head.at") + F.col("more")).alias("at"))))
    carried = counted.select("conv_id", "block", "first", "more", F.lag("last").over(by_block).alias("carried"), F.last("head", ignorenulls=True).over(earlier).alias("above"))
    return inside.join(carried, ["conv_id", "block"]).select(
        "conv_id", "turn", "quoted", "first", F.coalesce("before", "carried").alias("before"), (F.col("at") + F.col("more")).alias("place"),
        F.coalesce("head.turn", "above.turn", "first").alias("head"), F.coalesce(F.col("head.at") + F.col("more"), F.col("above.at"), F.lit(1)).alias("head_place"),
    )


def depths(ordered: DataFrame) -> DataFrame:
    """Rows (conv_id, head, up): how many replies are above each head of ``ordered``.

    A head's parent is somewhere below another head; a head jumps over that one to the next, twice as far in each round,
    so the rounds grow with the logarithm of the longest chain of quotations. Parents are always earlier: no circles.
    """
    heads = ordered.filter("turn = head").select("conv_id", "head", F.col("quoted").alias("turn"))
    parents = ordered.select("conv_id", "turn", F.col("head").alias("next"), (F.col("place") - F.col("head_place") + 1).alias("up"))
    scratch, n = Scratch(ordered.sparkSession), 0
    at = heads.join(parents, ["conv_id", "turn"], "left").select("conv_id", "head", F.coalesce("next", "head").alias("next"), F.coalesce("up", F.lit(0)).cast("long").alias("up"))
    at = scratch.table(at, "heads0")
    while True:
        above = at.select("conv_id", F.col("head").alias("next"), F.col("next").alias("far"), F.col("up").alias("more"))
        moved = at.join(above, ["conv_id", "next"]).select("conv_id", "head", F.col("far").alias("next"), (F.col("up") + F.col("more")).alias("up"), (F.col("far") != F.col("next")).alias("went"))
        moved = scratch.table(moved, f"heads{n + 1}")
        scratch.drop(f"heads{n}")
        at, n = moved.drop("went"), n + 1
        if not moved.filter("went").limit(1).count():
            return at.drop("next")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, reply_to, quoted, thread, depth, place, text) of the messages, quotes taken out.

    Sorting by conv_id and place gives reply-ordered conversations: no message stands before the one it replies to.
    ``reply_to`` is null for the first message; ``quoted`` tells whether it comes from a quotation. ``thread`` is the
    message that the chain of ``reply_to`` ends at and ``depth`` its length. Rows with a null conv_id or turn have no
    thread of others: they keep a null reply_to, their own turn as thread, depth 0 and a null place. Of rows that repeat
    (conv_id, turn) each stays with the same place, and quotations of any of them count. Null and empty texts become
    empty; texts and quotations may be of any length; an empty table gives no rows. Other columns are not read.
    """
    messages = conversations.select("conv_id", "turn", "role", "text")
    placed = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    linked = placed.select("conv_id", "turn").distinct().join(link(placed).withColumnRenamed("reply_to", "quoted"), ["conv_id", "turn"], "left")
    ordered = materialize(in_order(linked), "ordered")
    known = ordered.join(depths(ordered), ["conv_id", "head"]).select(
        "conv_id", "turn", F.coalesce("quoted", "before").alias("reply_to"), F.col("quoted").isNotNull().alias("quoted"),
        F.col("first").alias("thread"), (F.col("up") + F.col("place") - F.col("head_place")).alias("depth"), "place",
    )
    joined = messages.join(known, ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("quoted", F.lit(False)).alias("quoted"), F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("place").cast("long").alias("place"), own_text(lines_of(F.col("text"))).alias("text"),
    )


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(read_table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE raw_lines AS (
  SELECT conv_id, turn, role, rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM (SELECT *, row_number() OVER () AS rid FROM conversations)
), marked AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^[\x20\t]*((?:>[\x20\t]?)+)', 1), '[^>]', '', 'g')) AS depth, regexp_replace(line, '^[\x20\t]*((?:>[\x20\t]?)+)', '') AS body FROM raw_lines
), grouped AS (
  SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY n) AS g FROM (
    SELECT *, CASE WHEN trim(body) = '' OR lag(depth) OVER w IS DISTINCT FROM depth OR trim(lag(body) OVER w) = '' THEN 1 ELSE 0 END AS fresh FROM marked WINDOW w AS (PARTITION BY rid ORDER BY n))
), passages AS (
  SELECT conv_id, turn, depth, trim(regexp_replace(translate(string_agg(body, chr(10) ORDER BY n), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+', ' ', 'g')) AS form
  FROM grouped WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn, rid, g, depth
), wrote AS (SELECT conv_id, form, min(turn) AS origin FROM passages WHERE depth = 0 AND form <> '' GROUP BY 1, 2
), quotes AS (SELECT conv_id, turn, form, min(depth) AS depth FROM passages WHERE depth > 0 AND form <> '' GROUP BY 1, 2, 3
), links AS (
  SELECT conv_id, turn, arg_min(origin, depth * 1000000000 - origin) AS quoted_turn FROM quotes JOIN wrote USING (conv_id, form) WHERE origin < turn GROUP BY 1, 2
), replies AS (
  SELECT conv_id, turn, quoted_turn, coalesce(quoted_turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn)) AS reply_to, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place
  FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) LEFT JOIN links USING (conv_id, turn)
), chain AS (
  SELECT conv_id, turn, turn AS root, 0 AS depth FROM replies WHERE reply_to IS NULL
  UNION ALL SELECT r.conv_id, r.turn, c.root, c.depth + 1 FROM chain c JOIN replies r ON r.conv_id = c.conv_id AND r.reply_to = c.turn
), own AS (
  SELECT rid, conv_id, turn, role, trim(coalesce(string_agg(body, chr(10) ORDER BY n) FILTER (WHERE depth = 0), '')) AS text FROM marked GROUP BY 1, 2, 3, 4
)
SELECT own.conv_id, own.turn, role, reply_to, coalesce(quoted_turn IS NOT NULL, false) AS quoted, coalesce(root, own.turn) AS thread, coalesce(chain.depth, 0)::BIGINT AS depth, place, text
FROM own LEFT JOIN replies ON replies.conv_id = own.conv_id AND replies.turn = own.turn LEFT JOIN chain ON chain.conv_id = own.conv_id AND chain.turn = own.turn
"""
