from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np

from dossier.llm import quality
from tests_llm_helpers import words


def labelled(spark, n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = words(rng, rng.randint(20, 200))
        if not good:
            text = " ".join(w + rng.choice(["***", "$$$", "###"]) for w in text.split())
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_columns(spark):
    docs, labels = labelled(spark)
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 400
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held) >= 0.97 * len(held) and len(held) > 40
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_held_out_labels_are_not_learnt(spark):
    from pyspark.sql import functions as F

    docs, labels = labelled(spark)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.score_documents(docs, x).collect()} for x in (labels, flipped))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_moments_give_the_discriminant():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(500, 3)) @ np.diag([1, 2, 3]), rng.normal(2, 1, size=(300, 3))]
    model = quality.solve(np.array([500.0, 300.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]), 0.0, 0.0)
    for k, v in enumerate(x):
        cov = np.cov(v.T, bias=True)
        d = v[:5] - v.mean(0)
        want = np.log((500 + 1, 300 + 1)[k] / 802) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.log(np.linalg.det(cov)))
        assert np.allclose(model.log_density(v[:5])[:, k], want, atol=1e-6)


def test_edges(spark, edge_docs, clashing, empty_docs):
    _, labels = labelled(spark)
    odd = labels.union(spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 7, 0), (4, 1, 0), (4, 0, 0)], labels.schema))
    rows = quality.score_documents(edge_docs, odd).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.score_documents(edge_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_documents(empty_docs, labels).count() == 0
    docs, labels = labelled(spark)
    kept = quality.keep_good(docs.withColumn("__x", docs["doc_id"]), labels)
    assert kept.columns == ["doc_id", "text", "__x"]
    assert {r["doc_id"] % 3 > 0 for r in kept.collect()} == {True}
    assert quality.keep_good(clashing, labels).columns == clashing.columns
    assert quality.keep_good(empty_docs, labels).count() == 0


def plain_statistics(text):
    """The statistics of one text, one loop for each."""
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(w), sum(map(len, w))
    rate = lambda x: math.log1p(10 * x / (n + 5))
    count = lambda marks: sum(c in marks for c in text)
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
    return [
        math.log1p(n), math.log1p(chars / max(n, 1)), math.log1p(len(set(w))) / max(math.log1p(n), 0.5), rate(count("#*$%&<>")), rate(count("|")), rate(count("!")),
        rate(count(upper)), rate(count(digits)), rate(stutter), math.log1p(len(lines) - len(set(lines))), rate(count(".,")),
    ]


def test_statistics_against_plain_loops(spark, edge_docs):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    parts = ["a", "Bé", "#", "$$", "|", "!", "12", ".", ",", " ", "  ", "\n", "\n\n", "\t", "the the", "😀", "\x0b"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(edge_docs.select("doc_id", "text"))
    for r in quality.statistics(docs, F.col("text"), "x").collect():
        assert np.allclose(r["x"], plain_statistics(r["text"]), atol=1e-9), r["text"]
