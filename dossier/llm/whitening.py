"""Embedding whitening with a weighted multiplicity covariance.

Identical coded vectors are one row before anything is fitted: the fit list has each distinct vector once, with its
count or one as its weight. Sums are exact integers, and the covariance is a weighted product of centred matrices
for each Arrow batch, added up in Spark. Each distinct vector is whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.storage import broadcast_if_small, materialize, read_table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries of this size or more can't be coded exactly; their rows are left out as those with non-finite entries are.
LARGEST_ENTRY = float(1 << 40)
#: An eigenvalue of at most this share of the largest counts as none: nothing varies in its direction.
NO_VARIANCE = 1e-12


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, x), x = floor(SCALE * c) + SHIFT of every entry c as a double.

    Rows whose vector is null, empty or holds a null, non-finite or too large entry (LARGEST_ENTRY) are left out.
    Repeated rows stay repeated and a null id is kept.
    """
    c = F.col("v")
    good = F.forall(c, lambda e: F.coalesce(F.abs(e) < LARGEST_ENTRY, F.lit(False)))  # NaN is larger than any number
    plain = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(good & (F.size(c) > 0))
    return plain.select("vec_id", F.transform(c, lambda e: F.floor(e * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def _added(rows: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    """The sums of the array columns ``names`` over the rows of ``rows``, one row for each batch, by place."""
    out = {}
    for name in names:
        parts = rows.select(F.posexplode(name).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # d or d * d numbers
        found = dict(map(tuple, parts))
        out[name] = [found[i] for i in range(len(found))]
    return out


def totals(distinct: DataFrame, by_count: bool = False) -> tuple[int, list[int]]:
    """n and the sums by dimension of the fit list (x, count) of ``distinct``, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                weights = batch.column(1).to_numpy() if by_count else np.ones(batch.num_rows, np.int64)
                sums = (_matrix(batch.column(0), np.int64) * weights[:, None]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([[int(weights.sum()), *sums.tolist()]], pa.list_(pa.int64()))], names=["s"])

    n, *sums = _added(distinct.select("x", "count").mapInArrow(run, "s array<long>"), ["s"])["s"] or [0]
    return n, sums


def covariance(rows: DataFrame, centre: np.ndarray, n: int, scale: int = 1, by_count: bool = False) -> np.ndarray:
    """The covariance (divisor ``n``) of the rows (v, count), whose mean is ``centre`` / ``scale``: every batch is centred,
    then multiplied, with weights of one or the counts. With integer v and a scale the differences are exact before the division.
    """
    d = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = (_matrix(batch.column(0), centre.dtype.type) * scale - centre) / scale
                weighted = y * batch.column(1).to_numpy()[:, None] if by_count else y
                yield pa.RecordBatch.from_arrays([pa.array([(weighted.T @ y / n).ravel()], pa.list_(pa.float64()))], names=["s"])

    return np.array(_added(rows.mapInArrow(run, "s array<double>"), ["s"])["s"]).reshape(d, d)


def exact_squares(deviations: np.ndarray) -> list[int | None]:
    """The sum of squares of each row of longs, exact; null where it is no long."""
    most = max(int(np.abs(deviations).max(initial=0)), 1)
    if most * most * deviations.shape[1] < 1 << 63:
        return (deviations * deviations).sum(axis=1).tolist()
    found = [sum(v * v for v in row) for row in deviations.tolist()]
    return [x if x < 1 << 63 else None for x in found]


@dataclass(frozen=True)
class Whitener:
    """n and sums of the fit list, and the components as columns of ``axes`` with their eigenvalues, the largest first."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def there(self) -> np.ndarray:
        """Which of the components have any variance."""
        return self.values > NO_VARIANCE * max(float(self.values[0]) if len(self.values) else 0.0, 0.0)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        """Of n * x - sums for each row; 0 on a component without variance."""
        scale = np.where(self.there, 1 / np.sqrt(np.where(self.there, self.values, 1.0)), 0.0)
        return (deviations / self.n) @ self.axes * scale


def fit(distinct: DataFrame, components: int = COMPONENTS, by_count: bool = False) -> Whitener:
    n, sums = totals(distinct, by_count)
    centre = np.array(sums, np.int64)
    v = covariance(distinct.select("x", "count"), centre, n, n, by_count)
    values, axes = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(values)[::-1][:components]
    return Whitener(n, centre, axes[:, order], values[order], float(np.trace(v)))


def whiten(vectors: DataFrame, components: int = COMPONENTS, by_count: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of the rows of ``vectors`` that ``coded``
    keeps, one for each component up to ``components``.

    Every row of equal vectors gets the numbers of its distinct vector; repeated rows stay repeated. ``by_count`` weighs each
    distinct vector by its rows. A component without variance has whitened 0 and isn't part of identity_error, which then
    covers the others (0 if there are none). deviation is null where it exceeds a long. Vectors of another length than most
    (of equals the longer) are left out. Without rows the result is empty; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialize(coded(vectors, id_col, vector_col), "coded")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kind = rows.schema["vec_id"].dataType.simpleString()
    if lengths is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = rows.filter(F.size("x") == lengths["d"])
    distinct = materialize(rows.groupBy("x").agg(F.count("*").alias("count")), "distinct")
    model = fit(distinct, components, by_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviations = model.n * _matrix(batch.column(0), np.int64) - model.sums
            white = list(model.whiten(deviations)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exact_squares(deviations) if batch.num_rows else [], pa.int64()), pa.array(white, pa.list_(pa.float64()))], names=["x", "count", "deviation", "white"])

    done = materialize(distinct.mapInArrow(run, "x array<long>, count long, deviation long, white array<double>"), "whitened")
    error = identity_error(done, model, by_count)
    explained = F.array(*(F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.values))
    joined = rows.join(broadcast_if_small(done.select("x", "deviation", "white")), "x")
    return joined.select("vec_id", "deviation", F.posexplode("white").alias("i", "whitened")).select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("i") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def identity_error(done: DataFrame, model: Whitener, by_count: bool = False) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, measured anew."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                weights = batch.column(1).to_numpy()[:, None] if by_count else 1
                yield pa.RecordBatch.from_arrays([pa.array([(_matrix(batch.column(0), float) * weights).sum(axis=0)], pa.list_(pa.float64()))], names=["s"])

    white = done.select(F.col("white").alias("v"), "count")
    mean = np.array(_added(white.mapInArrow(run, "s array<double>"), ["s"])["s"]) / model.n
    off = np.abs(covariance(white, mean, model.n, 1, by_count) - np.eye(k))[np.ix_(model.there, model.there)]
    return float(off.max(initial=0.0))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
