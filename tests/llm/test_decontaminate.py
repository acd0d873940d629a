from __future__ import annotations

import random
from collections import Counter

from dossier.llm import decontaminate as dc
from tests_llm_helpers import words


def brute(docs, items):
    want = {}
    for doc_id, text in docs:
        w = dc.normal_words(text)
        found = dc.shingles(w)
        for item_id, item in items:
            v = dc.normal_words(item)
            bag = Counter(dc.shingles(v))
            if not bag or not found:
                if v and len(v) < 5 and w == v:
                    want[(doc_id, item_id)] = 1.0
                continue
            n = min(sum(bag.values()), len(found))
            best = max(dc.similarity(Counter(found[i : i + n]), bag) for i in range(len(found) - n + 1))
            if best >= 0.8:
                want[(doc_id, item_id)] = best
    return want


def test_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randint(12, 60))) for i in range(25)] + [(100, "a b c"), (101, None), (102, ""), (103, "Mixed, Case! punctuation (here) " + words(rng, 20))]
    docs = []
    for i in range(150):
        w = words(rng, rng.randint(5, 150)).split()
        if i % 2:
            passage = dc.normal_words(items[i % 25][1])
            passage = [p.decode() for p in passage]
            for _ in range(rng.randint(0, 3) if i % 4 == 1 else 0):
                passage[rng.randrange(len(passage))] = "edit"
            at = rng.randrange(len(w))
            w[at:at] = passage
        docs.append((i, " ".join(w)))
    docs += [(200, "A, b. c"), (201, "a b c d"), (202, None), (203, "xx mixed case PUNCTUATION here " + items[-1][1].split(") ")[1])]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 40
    small = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), words_per_block=100)
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in small.collect()} == want


def test_slots_find_every_print_within_the_radius():
    import numpy as np

    rng = random.Random(9)
    index = dc.Index()
    for k in range(20):
        index.add(k, dc.normal_words(words(rng, 30)))
    prints = [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 26))) for p in index.prints for _ in range(20)]
    found = dict(index.near(26, np.array(prints, np.uint64)))
    for i, p in enumerate(prints):
        assert sorted(found.get(i, [])) == [k for k, q in enumerate(index.prints) if (p ^ q).bit_count() <= dc.RADIUS]


def test_edges(spark, edge_docs, clashing, empty_docs):
    items = spark.createDataFrame([(1, "the same text twice over in the table"), (None, "equal id other text or"), (3, None)], "item_id long, text string")
    rows = dc.contaminated(edge_docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in rows] == [(7, 1, 1.0)] * 2
    kept = dc.decontaminate(clashing, items)
    assert kept.columns == clashing.columns and kept.count() == 10
    assert dc.decontaminate(empty_docs, items).count() == 0
    assert dc.decontaminate(edge_docs, items.limit(0)).count() == 12
    assert dc.contaminated(edge_docs, items.limit(0)).count() == 0
