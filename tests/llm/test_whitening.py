from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, by_count=False, k=16):
    """vec_id, x of the rows kept, and n, sums, axes, values, trace of their fit list."""
    kept = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    u, counts = np.unique(x, axis=0, return_counts=True)
    w = counts if by_count else np.ones(len(u), np.int64)
    n, sums = int(w.sum()), (u * w[:, None]).sum(0)
    y = u - sums / n
    v = (y * w[:, None]).T @ y / n
    values, axes = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:k]
    return kept, n, sums, axes[:, order], values[order], np.trace(v)


@pytest.mark.parametrize("by_count", [False, True])
def test_against_brute_force(spark, by_count):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(300, 24)) @ rng.normal(size=(24, 24))).astype(float).round(3).tolist()
    rows = [(i, base[i % 300 if i < 300 else 7]) for i in range(450)]  # one vector has a third of the rows
    rows += [(900, None), (901, []), (902, [None] + base[0][1:]), (903, [float("nan")] + base[0][1:]), (904, [float("inf")] + base[0][1:]), (None, base[3]), (5, base[5])]
    got = wh.whiten(spark.createDataFrame(rows, SCHEMA), by_count=by_count).toPandas()
    kept, n, sums, axes, values, trace = brute(rows, by_count)
    assert len(got) == 16 * len(kept) and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and 0 <= got["identity_error"][0] < 1e-9
    want = {}
    for i, x in kept:
        want.setdefault(i, (x, sum(int(v) ** 2 for v in n * x.astype(object) - sums)))
    got["vec_id"] = got["vec_id"].astype(object).where(got["vec_id"].notna(), None)
    signs = {}
    for r in got.itertuples():
        x, deviation = want[r.vec_id]
        k = r.component - 1
        expect = (x - sums / n) @ axes[:, k] / np.sqrt(values[k])
        sign = signs.setdefault(k, 1.0 if abs(r.whitened - expect) < 1e-8 else -1.0)
        assert abs(r.whitened - sign * expect) < 1e-8 and r.deviation == deviation
        assert abs(r.explained - values[k] / trace) <= 1e-9


def test_edges(spark):
    one = wh.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], SCHEMA)).collect()
    assert len(one) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
    assert wh.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None)], SCHEMA)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # another length than most, an entry that can't be coded, and clashing names of more columns
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(3)], "x", 1) for i in range(20)] + [(50, [1.0, 2.0], "x", 1), (51, [1e30, 1.0, 1.0], "x", 1)]
    got = wh.whiten(spark.createDataFrame(rows, SCHEMA + ", x string, count int"))
    assert got.select(F.countDistinct("vec_id")).first()[0] == 20 and got.count() == 60


def test_exact_squares():
    big = np.array([[3_000_000_000, -5, 1], [1, 2, 3], [1 << 62, 0, 0]])
    assert wh.exact_squares(big) == [9_000_000_000_000_000_026, 14, None]
