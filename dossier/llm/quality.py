"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

The statistics are Spark SQL expressions over the whole text. Fitting is one aggregation: for each class the count, the
sums and the sums of products of the statistics, so it uses every labelled row and the driver sees two rows. Each
class covariance is shrunk to the pooled one and to a sphere, its Cholesky factor is inverted once and kept with the
model; scoring is a matrix product for each Arrow batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.storage import broadcast_if_small, materialize, read_table, scratch_name

THRESHOLD = 0.3
#: Share of the pooled covariance in each class covariance, and of the sphere in the result.
TO_POOLED, TO_SPHERE = 0.1, 0.02
#: Smallest prior of a class; keeps a class that is rare in the labels from vanishing.
LEAST_PRIOR = 0.01
#: The filter fits on so many labelled documents at most, those of the smallest hash of their id.
FIT_DOCUMENTS = 200_000

FEATURES = ("size", "word_length", "variety", "symbols", "bars", "shouting", "capitals", "digits", "stutter", "lines_again", "stops")


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def statistics(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with the array column ``out``: the transformed statistics of ``text``. A null text counts as empty."""
    words, source, parts = (scratch_name(df, x) for x in ("words", "source", "parts"))
    df = df.withColumn(source, F.coalesce(text, F.lit("")))
    df = df.withColumn(words, word_array(F.col(source)))
    w, t = F.col(words), F.col(source)
    n = F.size(w).cast("double")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(
        parts,
        F.struct(
            n.alias("n"),
            F.char_length(F.array_join(w, "")).cast("double").alias("chars"),
            F.size(F.array_distinct(w)).cast("double").alias("distinct"),
            # one pass takes out everything but the characters that are counted below
            F.regexp_replace(t, r"[^#*$%&<>|!A-Z0-9.,]+", "").alias("marks"),
            F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).cast("double").alias("stutter"),
            F.size(lines).cast("double").alias("lines"),
            F.size(F.array_distinct(lines)).cast("double").alias("distinct_lines"),
        ),
    )
    p = F.col(parts)
    count = lambda keep: F.length(F.regexp_replace(p["marks"], f"[^{keep}]+", "")).cast("double")
    each = F.greatest(p["n"], F.lit(1.0))
    rate = lambda x: F.log1p(10 * x / (p["n"] + 5))  # noqa: E731  a mark or two in a short text says little
    found = [
        F.log1p(p["n"]),
        F.log1p(p["chars"] / each),
        F.log1p(p["distinct"]) / F.greatest(F.log1p(p["n"]), F.lit(0.5)),
        rate(count("#*$%&<>")),
        rate(count("|")),
        rate(count("!")),
        rate(count("A-Z")),
        rate(count("0-9")),
        rate(p["stutter"]),
        F.log1p(p["lines"] - p["distinct_lines"]),
        rate(count(".,")),
    ]
    return df.withColumn(out, F.array(*found)).drop(words, source, parts)


@dataclass(frozen=True)
class Discriminant:
    """For each class: mean, inverse Cholesky factor of the covariance, log determinant and log prior."""

    means: np.ndarray
    inverse_factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.means)))
        for k, mean in enumerate(self.means):
            z = (x - mean) @ self.inverse_factors[k].T
            out[:, k] = self.log_priors[k] - 0.5 * (np.einsum("ij,ij->i", z, z) + self.log_dets[k])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        d = self.log_density(x)
        return 1.0 / (1.0 + np.exp(np.clip(d[:, 0] - d[:, 1], -500, 500)))


def solve(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Discriminant:
    """The model of the class moments; a class without rows takes the mean and covariance of the other."""
    d = sums.shape[1]
    if not counts.sum():
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), np.log([0.5, 0.5]))
    there = np.maximum(counts, 1)[:, None]
    means = np.where(counts[:, None] > 0, sums / there, sums.sum(0) / counts.sum())
    scatter = [products[k] - counts[k] * np.outer(means[k], means[k]) for k in range(2)]
    pooled = sum(scatter) / counts.sum()
    pooled += np.eye(d) * max(1e-9, 1e-4 * np.trace(pooled) / d)
    scale = np.sqrt(np.diag(pooled))
    factors, dets = [], []
    for k in range(2):
        own = scatter[k] / counts[k] if counts[k] else pooled
        cov = ((1 - to_pooled) * own + to_pooled * pooled) / np.outer(scale, scale)
        cov = (1 - to_sphere) * cov + to_sphere * np.eye(d) * np.trace(cov) / d
        factor = np.linalg.cholesky(cov) * scale[:, None]
        factors.append(np.linalg.inv(factor))
        dets.append(2 * np.log(np.diag(factor)).sum())
    priors = np.clip((counts + 1) / (counts.sum() + 2), LEAST_PRIOR, 1 - LEAST_PRIOR)
    return Discriminant(means, np.stack(factors), np.array(dets), np.log(priors))


def fit(rows: DataFrame, x: str = "x", label: str = "label") -> Discriminant:
    """Fit on ``rows`` (``x`` array of statistics, ``label`` 0 or 1); rows with a null or other label are left out."""
    d = len(FEATURES)
    at = [F.get(F.col(x), F.lit(i)) for i in range(d)]
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(at[i]).alias(f"s{i}") for i in range(d)] + [F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i, j in upper]
    counts, total, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("k")).agg(F.count("*").alias("n"), *sums).collect():
        counts[r["k"]] = r["n"]
        total[r["k"]] = [r[f"s{i}"] for i in range(d)]
        for i, j in upper:
            products[r["k"], i, j] = products[r["k"], j, i] = r[f"p{i}_{j}"]
    return solve(counts, total, products)


def score_column(model: Discriminant, x: str) -> Column:
    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(values.to_numpy()).astype(float)) if len(values) else [], dtype=float)

    # a filter on the score must not be moved below the statistics: it would work them out once for each use
    return score.asNondeterministic()(F.col(x))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def one_label(labels: DataFrame) -> DataFrame:
    """Rows (id, label): the lowest quality that any row gives a document; null ids and labels are left out."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("label"))


def fit_on(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", x: str = "x") -> Discriminant:
    """Fit on the labelled rows of ``measured`` that are not held out. Only ids and statistics are shuffled."""
    rows = measured.select(F.col(id_col).alias("id"), F.col(x).alias("x")).join(one_label(labels), "id").filter(~held_out(F.col("id")))
    return fit(rows)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of every row of ``docs``, repeated rows included.

    Null and empty texts are scored as texts without words. Without any label every score is 0.5 at the prior. Columns
    other than id and text are not read.
    """
    measured = materialize(statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"), "x").select("doc_id", "x"), "statistics")
    model = fit_on(measured, labels)
    scored = measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, "x").alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more (ties stay), with all their columns.

    The discriminant is fitted on at most FIT_DOCUMENTS labelled documents, so that the others' statistics are worked out
    once, for their score. Null and empty texts are scored as texts without words; repeated rows get one score and stay
    or go together. Without any label every score is 0.5. An empty table gives no rows.
    """
    fitted = one_label(labels).filter(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(FIT_DOCUMENTS)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(broadcast_if_small(materialize(fitted, "labelled")), "id")
    model = fit(statistics(known, F.col("text"), "x"))
    x, score = scratch_name(docs, "x"), scratch_name(docs, "score")
    scored = statistics(docs, F.col(text_col), x).withColumn(score, score_column(model, x))
    return scored.filter(F.col(score) >= threshold).select(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
