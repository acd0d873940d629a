from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from dossier.llm import toxicity as tx
from tests_llm_helpers import words

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, rng):
    """Every eighth document is toxic: English abuse, or words of two starts that nobody has listed."""
    rows, labels = [], []
    for i in range(n):
        w, toxic = words(rng, rng.randint(8, 120)).split(), i % 8 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "pathetic", "clown"]) if i % 16 else rng.choice(["zorkva", "quublix"]) + rng.choice(["an", "ust", "ir", "of"]))
        rows.append((i, " ".join(w)))
        if i % 3 or i < 40:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_with_noisy_labels(spark):
    rng = random.Random(1)
    rows, labels = corpus(1600, rng)
    copied = words(rng, 60) + " idiot scum"  # a toxic passage copied many times must not make its other words toxic
    rows += [(5000 + i, copied) for i in range(80)]
    rows += [(6000 + i, copied.replace(" idiot scum", "") + " " + words(rng, 5)) for i in range(20)]
    labels += [(5000 + i, 1, 1) for i in range(80)]
    noisy = [(i, q, 1 - t if rng.random() < 0.02 else t) for i, q, t in labels]
    got = {r["doc_id"]: r for r in tx.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(noisy, LABELS)).collect()}
    assert len(got) == len(rows)
    truth = {i: i < 1600 and i % 8 == 0 or 5000 <= i < 6000 for i, _ in rows}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    wrong = [i for i in truth if got[i]["predicted"] != truth[i]]
    assert len(wrong) <= 0.01 * len(truth), wrong[:20]


def test_labels_of_held_out_rows_are_never_read(spark):
    rows, labels = corpus(300, random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    assert turned != labels
    one, other = (sorted(tx.score_documents(docs, spark.createDataFrame(x, LABELS)).select("doc_id", F.round("score", 9)).collect()) for x in (labels, turned))
    assert one == other


def test_label_model_finds_accuracies_and_shares_weight():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    votes = np.column_stack([np.where(y, rng.random(20_000) < a, rng.random(20_000) < b) for a, b in ((0.7, 0.01), (0.6, 0.05), (0.5, 0.1))])
    votes = np.column_stack([votes, votes[:, 2], votes[:, 2]]).astype(float)  # three voters that say the same
    gold = np.where(rng.random(len(y)) < 0.2, y.astype(int), -1)
    patterns, counts = np.unique(np.column_stack([votes, gold]), axis=0, return_counts=True)
    model = tx.fit_labels(patterns[:, :-1], patterns[:, -1], counts.astype(float))
    real = [y[votes[:, i] > 0].mean() for i in range(5)]
    assert np.abs(model.accuracy[:2] - real[:2]).max() < 0.1 and model.accuracy[0] > model.accuracy[1] > model.accuracy[2]
    assert model.weight[2] < 0.4 < model.weight[0]
    shown = np.array([[1, 1, 1, 1, 1], [1, 0, 0, 0, 0], [0, 0, 1, 1, 1], [0, 0, 0, 0, 0]], float)
    every, first, same, none = model.posterior(shown, np.full(4, -1))
    assert every > 0.99 and every > first > same > 0.3 and none < 0.1


def test_words_are_whole_at_any_block(monkeypatch):
    text = "Ünïcödé wörds AND more_of them 123 " * 40
    whole = tx.word_counts(text)
    for size in (1, 5, 17, 100):
        monkeypatch.setattr(tx, "BYTES_AT_ONCE", size)
        assert tx.word_counts(text) == whole
    assert tx.word_counts(None) == tx.word_counts("  \n") == {}


def test_edges(spark, edge_docs, clashing, empty_docs):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (5, 1, None), (None, 1, 1), (99, 0, 0)], LABELS)
    none = spark.createDataFrame([], LABELS)
    assert tx.score_documents(empty_docs, labels).count() == tx.score_documents(empty_docs, none).count() == 0
    got = tx.score_documents(edge_docs, labels).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert sorted(map(str, tx.score_documents(clashing, labels).collect())) == sorted(map(str, got))
    assert all(r["predicted"] == 0 for r in tx.score_documents(edge_docs, none).collect())
