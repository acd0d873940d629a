"""Agreement of the documents of a case, without pairs of all documents.

``cross_document_mismatch`` tells which cases hold documents that differ, ``amount_outliers`` which documents these are and
how many others of their case each differs from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE, LEAST = 0.01, 0.01


def differs(a: Column, b: Column) -> Column:
    """Amounts differ by over 1 % of the larger, and by over a cent."""
    return F.abs(a - b) > F.greatest(TOLERANCE * F.greatest(F.abs(a), F.abs(b)), F.lit(LEAST))


def cross_document_mismatch(documents: DataFrame) -> DataFrame:
    """Rows (case_id, n_documents, low, high, difference) of the cases in which any two amounts differ.

    If two amounts differ, so do the lowest and the highest, since the tolerance grows slower than the distance; so one
    aggregation finds what all pairs would. Null amounts and null cases are compared with nothing.
    """
    told = documents.filter("case_id IS NOT NULL AND amount IS NOT NULL").groupBy("case_id").agg(F.count("*").alias("n_documents"), F.min("amount").alias("low"), F.max("amount").alias("high"))
    return told.filter(differs(F.col("low"), F.col("high"))).withColumn("difference", F.round(F.col("high") - F.col("low"), 2))


def _lower(values: DataFrame) -> DataFrame:
    """Rows (case_id, x, n, nearest): of every row of ``values`` (case_id, x, n) how many lower ones differ from it, and
    the highest. a < x differ if a < x - t(x) and a + t(a) < x; either holds for all a up to some, so the lesser counts."""
    t = F.greatest(F.abs("x") * F.lit("0.01").cast("decimal(3,2)"), F.lit("0.01").cast("decimal(3,2)"))
    w = W.partitionBy("case_id").orderBy("v", "late").rowsBetween(W.unboundedPreceding, 0)
    found = []
    for by, at in ((F.col("x"), F.col("x") - t), (F.col("x") + t, F.col("x"))):
        wide = "decimal(28,6)"
        there = values.select("case_id", by.cast(wide).alias("v"), F.lit(1).alias("late"), "n", F.col("x").alias("last"), F.lit(None).cast("decimal(18,4)").alias("x"))
        asked = values.select("case_id", at.cast(wide).alias("v"), F.lit(0).alias("late"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("decimal(18,4)").alias("last"), "x")
        found.append(there.union(asked).select("case_id", "x", F.sum("n").over(w).alias("n"), F.max("last").over(w).alias("nearest")).filter("x IS NOT NULL"))
    return found[0].union(found[1]).groupBy("case_id", "x").agg(F.min(F.struct("n", "nearest")).alias("m")).select("case_id", "x", "m.n", "m.nearest")


def amount_outliers(documents: DataFrame) -> DataFrame:
    """Rows (case_id, document_id, amount, n_below, n_above, nearest_below, nearest_above) of the documents (case_id,
    document_id, amount) that differ from another of their case: from how many below and above, and the nearest of them.

    Every pair of a case counts, as in a self-join, but none is made. Amounts are compared to four decimals; null amounts
    and null cases are compared with nothing. The distinct amounts of one case are sorted in one task.
    """
    told = documents.filter("case_id IS NOT NULL").select("case_id", "document_id", "amount", F.col("amount").cast("decimal(18,4)").alias("x")).filter("x IS NOT NULL")
    values = told.groupBy("case_id", "x").agg(F.count("*").alias("n"))
    below = _lower(values).select("case_id", "x", F.col("n").alias("n_below"), F.col("nearest").cast("double").alias("nearest_below"))
    negated = _lower(values.select("case_id", (-F.col("x")).cast("decimal(18,4)").alias("x"), "n"))
    above = negated.select("case_id", (-F.col("x")).cast("decimal(18,4)").alias("x"), F.col("n").alias("n_above"), (-F.col("nearest")).cast("double").alias("nearest_above"))
    sides = below.join(above, ["case_id", "x"]).filter("n_below + n_above > 0")
    return told.join(sides, ["case_id", "x"]).select("case_id", "document_id", "amount", "n_below", "n_above", "nearest_below", "nearest_above")


def value_classes(documents: DataFrame, field: str) -> DataFrame:
    """Rows (case_id, value, n_documents, first_document, agreed): distinct values of a field within each case."""
    found = documents.filter(F.col(field).isNotNull()).groupBy("case_id", F.col(field).alias("value")).agg(F.count("*").alias("n_documents"), F.min("document_id").alias("first_document"))
    return found.withColumn("agreed", F.count("*").over(W.partitionBy("case_id")) == 1)


def majority_value(documents: DataFrame, field: str) -> DataFrame:
    """Rows (case_id, value, status): agreed, majority (over half of the documents) or conflict, with the most frequent
    value; of equals the smallest."""
    found = documents.filter(F.col(field).isNotNull()).groupBy("case_id", F.col(field).alias("value")).agg(F.count("*").alias("n"))
    best = found.groupBy("case_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"), F.sum("n").alias("all"))
    share = -F.col("b.n")
    return best.select("case_id", "b.value", F.when(share == F.col("all"), "agreed").when(2 * share > F.col("all"), "majority").otherwise("conflict").alias("status"))
