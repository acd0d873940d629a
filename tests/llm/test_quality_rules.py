from __future__ import annotations

import collections
import math
import random
import re

from dossier.llm import quality_rules as qr
from tests_llm_helpers import words


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts_against_brute_force(spark, edge_docs):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "b", "é", "#", " ", " ", "\n", "\t"]) for _ in range(rng.randint(0, 80)))) for i in range(600)]
    rows += [(600, "a b c " * 2000), (601, "x y"), (602, " \n a\n a\n\na b c d a b c")]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    texts = dict(rows)
    for r in qr.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect():
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, texts[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] <= (not r["base_failed"])


def test_ratio_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, 60) if i % 4 else " ".join(w + "###" for w in words(rng, 60).split())) for i in range(40)]
    labels = [(i, int(i % 4 > 0)) for i in range(40)] + [(None, 1), (3, None), (3, 1), (99, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = docs.select("doc_id", qr.ngram_buckets(qr.words_of(qr.ngram_text(docs["text"]))).alias("b"))
    grams = {r["doc_id"]: r["b"] for r in cut.collect()}
    raw = collections.Counter(b for x in grams.values() for b in x)
    target = collections.Counter(b for i, x in grams.items() if i % 4 for b in x)
    n, m = sum(raw.values()), sum(target.values())
    share = lambda c, of, b: (c[b] + of * qr.SMOOTHING / qr.BUCKETS) / (of * (1 + qr.SMOOTHING))
    for r in qr.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect():
        x = grams[r["doc_id"]]
        want = sum(math.log(share(target, m, b) / share(raw, n, b)) for b in x) / len(x)
        assert abs(r["llr"] - want) < 1e-9
        assert r["kept"] == (r["doc_id"] % 4 > 0)


def test_edges(spark, edge_docs, clashing, empty_docs):
    labels = spark.createDataFrame([(1, 1), (6, 1)], "doc_id long, quality int")
    assert qr.judge(edge_docs, labels).count() == 12
    assert qr.judge(clashing, labels).count() == 12
    assert qr.judge(empty_docs, labels).count() == 0
    assert {r["llr"] for r in qr.judge(edge_docs, labels.limit(0)).collect()} == {0.0}
