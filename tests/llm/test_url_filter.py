from __future__ import annotations

import itertools
import math
import random
import re

from dossier.llm import url_filter as uf


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def fixed(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in uf.FIXED_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


URLS = [None, "", "no scheme", "http://", "HTTP://Éx.COM/en/x?a://b", "a://b://c/d", "http://example.com/en/7x", "http://x.example.com:80/en/7", "https://www.example.net/de/81", "https://notexample.net/de/8", "http://com/en/", "http://xcom/en/", "http://a.org?/es/", "http://a.org/es/#f", "http://a.org/en/\n/x"]


def test_fixed_rules_and_parsing(spark):
    rng = random.Random(1)
    urls = URLS + ["".join(rng.choice(["http", "://", "/", "?", "#", "A.com", "example.net", ".", "/de/8", "/en/", "é"]) for _ in range(rng.randint(0, 7))) for _ in range(500)]
    rows = list(enumerate(urls)) + [(0, URLS[6])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = uf.judge(pages, labels, uf.fixed_rules(spark)).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *host_path(u), *(fixed(*host_path(u)) or (None, "allow"))) for i, u in rows), key=repr)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=repr) == want


def test_mined_rules_block_and_match_brute_force(spark):
    rng = random.Random(2)
    pages, labels = [], []
    for i in range(1200):
        spam = i % 4 == 0
        host = "spam-farm.example.gov" if spam else f"h{rng.randint(0, 9)}.example.gov"
        pages.append((i, f"http://{host}/{rng.choice(['a', 'b', 'c'])}/x{i}" + ("?ref=1" if rng.random() < 0.5 else "")))
        if i % 2 == 0:
            labels.append((i, 0 if spam else 1, 0))
    labels += [(None, 0, 0), (2, None, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: r for r in uf.judge(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), uf.fixed_rules(spark)).collect()}
    assert all((got[i]["verdict"] == "block") == (i % 4 == 0) for i in range(1200))
    assert got[0]["mined"] == "host=spam-farm"
    parsed = frame.select("page_id", "url", uf.host_of(frame["url"]).alias("host"), uf.path_of(frame["url"]).alias("path"))
    sets = parsed.select(parsed["page_id"].alias("key"), uf.tokens_of(parsed["url"], parsed["host"], parsed["path"]).alias("tokens"))
    rules = spark.createDataFrame([("r1", ["host=h1"], 0.7, 0.1), ("r2", ["host=h1", "segment=a"], 0.9, 0.1), ("r3", ["query=ref"], 0.8, 0.1)], "rule_id string, tokens array<string>, confidence double, support double")
    found = {r["key"]: (r["mined"], r["confidence"]) for r in uf.match_rules(sets, rules).collect()}
    for r in sets.collect():
        fits = [(-c, len(t), i) for i, t, c in (("r1", ["host=h1"], 0.7), ("r2", ["host=h1", "segment=a"], 0.9), ("r3", ["query=ref"], 0.8)) if set(t) <= set(r["tokens"])]
        assert found.get(r["key"]) == ((min(fits)[2], -min(fits)[0]) if fits else None)


def test_edges(spark):
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "page_id long, url string, html string, verdict string, key string")
    assert uf.judge(empty, labels, uf.fixed_rules(spark)).count() == 0
    odd = spark.createDataFrame([(None, None, None, "x", "y"), (1, "http://a.com/en/", None, None, None)], empty.schema)
    assert sorted(r["verdict"] for r in uf.judge(odd, labels, uf.fixed_rules(spark)).collect()) == ["allow", "block"]


def test_parts_deep_in_a_url_are_learned(spark):
    """Hosts under two-label tops, words of later path segments and later query keys, each of a few pages among many."""
    rng = random.Random(4)
    kinds = {0: "http://www.spamsite.co.uk/p{i}", 1: "http://h{h}.org.gov/en/blog/{i}/casino-bonus-{i}.html", 2: "http://h{h}.org.gov/a/{i}?page=1&aff={i}"}
    pages = [(i, kinds.get(i % 40, "http://h{h}.org.gov/{w}/{i}").format(i=i, h=rng.randint(0, 99), w=rng.choice("abc"))) for i in range(4000)]
    labels = [(i, 0 if i % 40 in kinds else 1, 0) for i in range(0, 4000) if i % 3]
    got = uf.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), uf.fixed_rules(spark)).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {i for i, _ in pages if i % 40 in kinds}


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 20_000 + "com/en/1", "http://x.com/" + "b/" * 20_000, "http://x.com/en/" + "c" * 100_000, "http://x.net/de/?" + "k=1&" * 20_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in uf.judge(pages, labels, uf.fixed_rules(spark)).collect()}
    assert got == {0: ("com/en/", "block"), 1: (None, "allow"), 2: ("com/en/", "block"), 3: ("net/de/", "allow")}


def brute_rules(rows, confidence=uf.MIN_CONFIDENCE, cases=uf.MIN_CASES):
    """The rules of (tokens, bad) as {tokens: share of bad}, without those that one within them is as good as."""
    found = {}
    for n in range(1, 1 + max(len(t) for t, _ in rows)):
        for one in {c for t, _ in rows for c in itertools.combinations(sorted(t), n)}:
            marks = [bad for t, bad in rows if set(one) <= set(t)]
            p, k, z = sum(marks) / len(marks), len(marks), uf.SURE
            low = (p + z * z / (2 * k) - z * math.sqrt(p * (1 - p) / k + z * z / (4 * k * k))) / (1 + z * z / k)
            if sum(marks) >= cases and p >= confidence and low >= confidence and not any(set(o) < set(one) and q >= p for o, q in found.items()):
                found[one] = p
    return found


def test_combinations_of_tokens_that_tell_nothing_alone(spark):
    """Two of a URL's query keys are bad together, and neither tells anything alone: its nine others tell more."""
    rng = random.Random(6)
    pages, labels = [], []
    for i in range(800):
        one, two = i % 2, i // 2 % 2
        bad = one == two
        keys = [f"k{k}" + ("y" if rng.random() < (0.6 if bad else 0.4) else "n") for k in range(9)] + ["one"] * one + ["two"] * two
        pages.append((i, "http://a.gov/?" + "&".join(f"{k}={i}" for k in keys)))
        labels.append((i, 0 if bad else 1, 0))
    frames = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in uf.judge(*frames, uf.fixed_rules(spark)).collect()}
    assert {(got[i]["verdict"], got[i]["mined"]) for i in range(3, 800, 4)} == {("block", "query=one&query=two")}


def test_all_rules_are_mined(spark):
    """Rows of up to eleven tokens, some of which always go together or are in every row, against all combinations."""
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        some = [x for x in "abcdefg" if rng.random() < 0.6]
        bad = ("a" in some and "b" in some and rng.random() < 0.95) or ("g" in some and "c" not in some) or rng.random() < 0.2
        rows.append((sorted([*some, *("xy" if "a" in some else ""), "z", *(["pure"] if bad and rng.random() < 0.2 else [])]), bad))
    rules, names = uf.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    stands = {r["token"]: r["item"] for r in names.collect()}
    got = {tuple(r["tokens"]): round(r["confidence"], 9) for r in rules.collect()}
    want = {tuple(sorted({stands[t] for t in one})): round(p, 9) for one, p in brute_rules(rows).items()}
    assert got == want and len(got) > 3 and max(map(len, got)) > 1
    assert stands.get("x") == stands.get("a") == "a"
