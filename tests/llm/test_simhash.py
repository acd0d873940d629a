from __future__ import annotations

import collections
import random

import xxhash
from pyspark.sql import functions as F

from dossier.llm import simhash
from dossier.llm.components import connected_components
from tests_llm_helpers import words


def brute_print(text, size=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, prints):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[a] = b
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return [least[find(i)] for i in range(len(rows))]


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        base = words(rng, 300).split() if i % 6 == 0 else base  # noqa: F821
        w = list(base)
        if i % 3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 - i, " ".join(w)))
    rows += [(5, None), (3, ""), (4, " \n"), (None, "x y z"), (9, "x y z"), (9, "x y z"), (11, "X  Y\tz")]
    prints = [brute_print(t) for _, t in rows]
    want = collections.Counter((i, format(p, "016x"), c) for (i, _), p, c in zip(rows, prints, brute_components(rows, prints), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in simhash.simhash_components(df).collect())
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 20


def test_fingerprints_of_many_blocks(monkeypatch):
    """Every shingle counts, however a text falls into blocks."""
    rng = random.Random(12)
    texts = [words(rng, n) for n in [*range(1, 60), 200, 1000]] + ["y " * 40 + "x " * 43]
    for block in (1, 8, 9, 65_536):
        monkeypatch.setattr(simhash, "HASHES_AT_ONCE", block)
        for t in texts:
            assert simhash.simhash(simhash.text_words(t), 3) == [brute_print(t)]
    monkeypatch.undo()
    for t in ("y " * 32_768 + "x " * 32_771, words(rng, 200_000)):
        assert simhash.simhash(simhash.text_words(t), 3) == [brute_print(t)]


def test_links_find_every_pair_within_the_radius(spark):
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for p in prints for _ in range(3)]
    prints = sorted({simhash.signed(p) for p in prints})
    df = spark.createDataFrame([(p, p) for p in prints], "key long, f0 long")
    for radius in (1, 2, 3):
        got = {frozenset(r) for r in simhash.links(df, 1, 64 // max(2, radius // 2 + 1), radius).collect()}
        want = {frozenset((a, b)) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
        assert got == want


def test_connected_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (1, 0)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_of_components(edge_docs, clashing, empty_docs):
    got = simhash.simhash_components(edge_docs)
    assert got.count() == 12
    assert sorted(map(str, simhash.simhash_components(clashing).collect())) == sorted(map(str, got.collect()))
    zeros = [r for r in got.collect() if r["fingerprint"] == "0" * 16]
    assert {r["component_id"] for r in zeros} == {1}
    assert simhash.simhash_components(empty_docs).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark):
    rng = random.Random(11)
    rows, groups = [], []
    for g in range(30):
        base = words(rng, 200).split()
        group = []
        for k in range(4):
            w = list(base)
            if k == 1:
                w[rng.randrange(200)] = "edited"
            if k == 2:
                w = [x.upper() for x in w]
            if k == 3:
                del w[100:103]
            group.append(1000 - (4 * g + k))
            rows.append((group[-1], ("  " if k == 2 else " ").join(w)))
        groups.append(group)
    lone = [(i, words(rng, 150)) for i in range(2000, 2040)]
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows + lone, "doc_id long, text string")).collect()}
    assert {i for i, _ in lone} <= kept
    assert [sum(i in kept for i in g) for g in groups] == [1] * 30
    assert all(min(g) in kept for g in groups)


def test_edges_of_deduplicate(edge_docs, clashing, empty_docs):
    kept = simhash.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = collections.Counter((r["doc_id"], (r["text"] or "")[:8]) for r in kept.collect())
    assert rows[(7, "the same")] == 1 and rows[(8, "equal id")] == 2 and rows[(1, "")] == 1 and rows[(None, "")] == 1
    assert sum(rows.values()) == 11
    assert simhash.deduplicate(clashing).columns == clashing.columns
    assert simhash.deduplicate(clashing).count() == 11
    assert simhash.deduplicate(empty_docs).count() == 0


def brute_kept(rows, least=0.8):
    """The ids that stay of (id, text) with distinct ids: the smallest of each component of pairs of ``least``."""
    sets, root = [], {i: i for i, _ in rows}
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= least * (len(sets[i]) + len(sets[j]) - shared):
                low, high = sorted((find(a), find(rows[j][0])))
                root[high] = low
    return {i for i in root if find(i) == i}


def test_deduplicate_equals_brute_force_at_the_threshold(spark):
    """Copies of 0.79 to 0.85 that differ by one block, appended, cut off or replaced."""
    rng = random.Random(23)
    rows = []
    for g in range(150):
        n = rng.choice([60, 120, 300, 600])
        base = words(rng, n).split()
        jaccard = rng.choice([0.79, 0.8, 0.805, 0.81, 0.82, 0.85])
        kind = g % 3
        if kind == 0:
            copy = base + words(rng, round((n - 4) * (1 / jaccard - 1))).split()
        elif kind == 1:
            copy = base[: round((n - 4) * jaccard) + 4]
        else:
            k, at = max(1, round((n - 4) * (1 - jaccard) / (1 + jaccard)) - 4), rng.randrange(5, n // 2)
            copy = base[:at] + words(rng, k).split() + base[at + k :]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    want = brute_kept(rows)
    assert 150 <= len(want) <= 200
    got = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want, (len(got), len(want))


def test_stage_fingerprint_is_of_distinct_shingles(spark):
    """A passage repeated many times hardly changes the set of shingles, so it hardly changes the fingerprint."""
    rng = random.Random(29)
    rows = []
    for g in range(20):
        base = words(rng, 300).split()
        rows += [(2 * g, 1, " ".join(base)), (2 * g + 1, 1, " ".join(base[:120] + base[100:120] * 10 + base[120:]))]
    prints = {r["id"]: r for r in simhash._text_prints(spark.createDataFrame(rows, "id long, row long, text string"), 5, 4, 0.8).collect()}
    apart = [sum(((prints[2 * g][f"f{k}"] ^ prints[2 * g + 1][f"f{k}"]) & (2**64 - 1)).bit_count() for k in range(4)) for g in range(20)]
    assert max(apart) <= 42, sorted(apart)
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.deduplicate(docs).collect()} == {2 * g for g in range(20)}


def test_texts_of_one_fingerprint_are_compared_with_each_other(spark, monkeypatch):
    """Equal fingerprints of different texts: two near copies that differ from the text that leads theirs are found."""
    rng = random.Random(31)
    rows = []
    for g in range(12):
        base = words(rng, 100).split()
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base[:50], "changed", *base[51:]]))]
    real = simhash._text_prints
    monkeypatch.setattr(simhash, "_text_prints", lambda *how: real(*how).withColumns({f"f{k}": F.lit(5).cast("long") for k in range(4)}))
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * g for g in range(12)}, len(kept)


def test_stage_recall_on_near_copies_of_a_large_group(spark):
    """One group of copies of one base with one to ten edits, and of others that share a passage: every link is kept."""
    rng = random.Random(37)
    base, passage = words(rng, 160).split(), words(rng, 60).split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(1, 10)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(passage + words(rng, 60).split())) for i in range(100)]
    want = brute_kept(rows)
    assert 101 < len(want) < 380
    got = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want, (len(got), len(want))


def test_stars_are_within_the_radius_and_few(spark):
    rng = random.Random(41)
    half = rng.getrandbits(32)
    prints = sorted({simhash.signed(half << 32 | 1 << b | 1 << c) for b in range(32) for c in range(b)})
    found = [tuple(r) for r in simhash.stars(spark.createDataFrame([(p,) for p in prints], "f0 long"), 3).collect()]
    assert found and len(found) <= simhash.LEADERS * 34 * len(prints)
    assert all(a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in found)


def test_exact_join_makes_links_only(spark):
    """A group of near copies, most of which are just too far from each other: the join makes no pair that is no link."""
    rng = random.Random(43)
    base, rows = words(rng, 160).split(), []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, i, " ".join(w)))
    prints = simhash._text_prints(spark.createDataFrame(rows, "id long, row long, text string"), 5, 1, 0.8)
    scratch = simhash.Scratch(spark)
    met, sets = simhash.prefix_slots(prints, scratch)
    split = prints.select("key", F.col("key").alias("part"))
    made = simhash.prefix_links(met, sets, split, 0.8, scratch).distinct().count()
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, _, t in rows)]
    links = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(grams) for b in grams[:i])
    assert made == links and 20 < links < 1000, (made, links)
