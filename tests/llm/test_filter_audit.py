from __future__ import annotations

import random
import re
from itertools import permutations

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from dossier.llm import filter_audit as fa
from tests_llm_helpers import words

KEYS = ["part", "filter_order", "step"]
VALUES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """The audit by sets of row numbers."""
    first: dict[str, int] = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            t = text or ""
            first[t] = min(first.get(t, doc_id), doc_id)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    parts: dict[str, list] = {}
    for doc_id, text, source in docs:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), doc_id is not None and doc_id > first[t]]
        parts.setdefault(source or "", []).append((fails, doc_id in good, doc_id in toxic))
    out = {}
    for part, rows in parts.items():
        removed_by = dict.fromkeys(range(5), 0)
        for order in permutations(range(5)):
            left = list(range(len(rows)))
            for step, f in enumerate(order):
                gone = [i for i in left if rows[i][0][f]]
                left = [i for i in left if not rows[i][0][f]]
                removed_by[f] += len(gone)
                failing = sum(r[0][f] for r in rows)
                alone = sum(r[0][f] and sum(r[0]) == 1 for r in rows)
                out[part, "".join("ABCDE"[i] for i in order), step + 1] = [f, len(left), len(gone), failing - len(gone), alone, sum(rows[i][1] for i in gone), sum(rows[i][2] for i in gone)]
        for (p, order, _step), v in out.items():
            if p == part and len(v) == 7:
                v.append(removed_by[v[0]])
    return {k: v[1:] for k, v in out.items()}


def some_docs(n, rng):
    texts = [words(rng, rng.choice([0, 3, 49, 50, 60, 200])) for _ in range(n // 3)] + [None, "", "A" * 60, "x # y", ("a b c " * 40)]
    rows = []
    for _ in range(n):
        text = rng.choice(texts)
        rows.append((rng.choice([None, *range(n)]), text and text + rng.choice(["", " THE LOUD END", " 5%"]), rng.choice(["hot", "hot", "hot", "a", None, ""])))
    return rows


def test_against_brute_force_and_sql(spark):
    rng = random.Random(1)
    docs = some_docs(300, rng)
    docs = [(i, t, s) for i, (_, t, s) in enumerate(docs)] + docs[:20] + docs[:5]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    la = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r[k] for k in KEYS): [r[v] for v in VALUES] for r in fa.audit(d, la).collect()}
    assert got == brute(docs, labels)
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    db.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    rows = db.sql(fa.SQL).fetchall()
    columns = [c[0] for c in db.sql(fa.SQL).description]
    assert {tuple(dict(zip(columns, r, strict=True))[k] for k in KEYS): [dict(zip(columns, r, strict=True))[v] for v in VALUES] for r in rows} == got


def test_ranges_add_up(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(some_docs(200, rng))], "doc_id long, text string, source string")
    failed = fa.failures(docs).select("part", "mask", F.lit(1).alias("good"), F.lit(0).alias("toxic"))
    whole = {tuple(r[c] for c in r.asDict()) for r in fa.case_sizes(fa.posting_lists(failed)).collect()}
    assert whole == {tuple(r[c] for c in r.asDict()) for r in fa.case_sizes(fa.posting_lists(failed, range_rows=7)).collect()}
    assert len(whole) == 80 * len({r[0] for r in whole})


def test_galloping_differences():
    rng = random.Random(3)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randint(0, 40))) for _ in range(4)]
        assert fa.difference_size(lists[0], lists[1:]) == len(set(lists[0]) - set().union(*lists[1:]))
        assert list(fa.common(lists[0], lists[1])) == sorted(set(lists[0]) & set(lists[1]))


def test_edges(spark, edge_docs, clashing, empty_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(empty_docs, labels).count() == 0
    got = fa.audit(edge_docs, labels)
    assert got.count() == 600 * 2 and got.filter("good_lost + toxic_lost > 0").count() == 0
    assert sorted(map(str, fa.audit(clashing, labels).collect())) == sorted(map(str, got.collect()))
