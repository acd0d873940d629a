"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Every text is cut into words, and its words and word pairs are hashed into a fixed number of buckets. Counts over all
documents give the raw-corpus multinomial, counts over trusted documents the target. A document's score is the mean of
log(target / raw) over its n-grams, and every document is held against the same threshold. The two multinomials are one
array of ``buckets`` weights, whatever the size of the corpus; it reaches the tasks as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.storage import materialize, read_table

BUCKETS = 1 << 14
#: Bound on the trusted documents that the target is fitted on: those with the smallest hash of their id.
TRUSTED_DOCUMENTS = 20_000
#: Added to every bucket's count, as a share of the mean count of a bucket.
SMOOTHING = 0.1
#: Mean log-likelihood ratio below which a document is not kept.
THRESHOLD = -0.2
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

WORD_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def ngram_text(text: Column) -> Column:
    """The text whose words are hashed: marks stand alone, so that they are n-grams of their own."""
    return F.regexp_replace(F.lower(text), r"([#*$%&<>|!]+)", " $1 ")


def ngram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and all pairs of neighbours."""

    def bucket(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")

    def pair(w: Column, i: Column) -> Column:
        return bucket(w, F.get(words, i + 1))

    ones = F.transform(words, lambda w: bucket(w))
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), pair)
    return F.concat(ones, pairs)


def with_repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add ``out``: words that stand in a window of three words which the text has twice or more, each counted once.

    Windows are put in order as one number each, 36 bits of hash above 28 bits of position. Neighbours with equal hash
    bits are candidates, equal windows always are, and candidates are held against each other by their words. Each step
    is a column of its own, since a lambda works its outer expressions out again for every element.
    """
    w = F.col(words)

    def hashed(x: Column, i: Column) -> Column:
        return F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), 28).bitwiseOR(i.cast("long"))

    def beside(x: Column, i: Column) -> Column:
        same = lambda y: F.coalesce(F.shiftright(x, 28) == F.shiftright(y, 28), F.lit(False))
        return same(F.get("__codes", i - 1)) | same(F.get("__codes", i + 1))

    def window(x: Column) -> Column:
        at = x.bitwiseAND(F.lit((1 << 28) - 1)).cast("int")
        return F.struct(F.get(w, at).alias("a"), F.get(w, at + 1).alias("b"), F.get(w, at + 2).alias("c"), at.alias("at"))

    def twice(x: Column, i: Column) -> Column:
        same = lambda y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        return same(F.get("__near", i - 1)) | same(F.get("__near", i + 1))

    def cover(acc: Column, at: Column) -> Column:
        return F.struct((acc["n"] + at + 3 - F.greatest(acc["end"], at)).alias("n"), (at + 3).alias("end"))

    df = df.withColumn("__codes", F.sort_array(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), hashed)))
    df = df.withColumn("__near", F.sort_array(F.transform(F.filter("__codes", beside), window)))
    starts = F.sort_array(F.transform(F.filter("__near", twice), lambda x: x["at"]))
    n = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), cover, lambda acc: acc["n"])
    return df.withColumn(out, n.cast("long")).drop("__codes", "__near")


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_DOCUMENTS) -> DataFrame:
    """Ids of at most ``bound`` documents of quality 1, those with the smallest hash; repeated and null ids aside."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("trusted_id")).distinct()
    return good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(bound)


def fit_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with the array of log(target / raw) for each bucket, of the rows (doc_id, text) of ``docs``.

    Without trusted documents every weight is 0.
    """
    grams = docs.join(F.broadcast(trusted), docs["doc_id"] == F.col("trusted_id"), "left")
    grams = grams.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), words_of(ngram_text(F.coalesce("text", F.lit("")))).alias("w"))
    rows = grams.select("t", F.explode(ngram_buckets(F.col("w"), buckets)).alias("bucket"))
    counts = materialize(rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")), "counts")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    totals = {c: F.greatest(counts.agg(F.coalesce(F.sum(c), F.lit(0))).scalar(), F.lit(0)) for c in ("raw", "target")}  # one row each

    def share(c: str) -> Column:
        n = F.greatest(totals[c], F.lit(1))
        return (F.col(c) + n * (smoothing / buckets)) / (n * (1 + smoothing))

    weighted = every.select("bucket", F.when(totals["target"] == 0, F.lit(0.0)).otherwise(F.log(share("target") / share("raw"))).alias("weight"))
    return weighted.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("weights"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr).

    One row for each row of ``docs``, repeated rows included. A null text has no words; a text without words has llr 0
    and fails the base rules. Other columns are not read.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    weights = materialize(fit_weights(plain, trusted_ids(labels)), "weights")
    weight = weights.select("weights").scalar()  # one row of a fixed size
    text = F.coalesce("text", F.lit(""))
    cut = plain.select("doc_id", text.alias("text")).select("doc_id", "text", words_of(F.col("text")).alias("words"), words_of(ngram_text(F.col("text"))).alias("grams"))
    counted = with_repeat_words(cut, "words", "n_repeat_words")
    base = base_columns(F.col("text"), F.col("words"))
    measured = counted.select("doc_id", "n_repeat_words", *(c.alias(k) for k, c in base.items()), ngram_buckets(F.col("grams")).alias("buckets"), weight.alias("weights"))
    sums = F.aggregate("buckets", F.lit(0.0), lambda acc, b: acc + F.get("weights", b))
    measured = measured.withColumn("llr", F.coalesce(sums / F.nullif(F.size("buckets"), F.lit(0)), F.lit(0.0))).drop("buckets", "weights")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = measured.withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
