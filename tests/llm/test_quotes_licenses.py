from __future__ import annotations

import random

import duckdb
import pandas as pd

from dossier.llm import licenses, quotes

MESSAGES = [
    (1, 0, "user", "Hello there.\n\nHow are you?"),
    (1, 1, "assistant", "> how are  YOU?\nFine, thanks."),
    (1, 2, "user", "> > How are you?\n> Fine, thanks.\nGood!"),
    (1, 3, "assistant", "> Hello there\nHi again"),
    (1, 4, "user", "> unknown thing\nok"),
    (1, 5, "x", "> Good!\n>> Fine thanks\nyes\n> tail"),
    (2, 0, "user", None),
    (2, 1, "a", ""),
    (2, 3, "a", ">"),
    (None, 1, "u", "> Hello there."),
    (1, None, "u", "x"),
    (1, 2, "user", "> Hello there.\ndup"),
    (3, 0, "u", "a"),
    (3, 2000, "u", "> a"),
    (3, 5000, "u", "b"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(frame, columns):
    return sorted([tuple(None if pd.isna(v) else v for v in row) for row in frame[columns].itertuples(index=False)], key=repr)


def same_as_sql(df, found, sql, view):
    db = duckdb.connect()
    db.register(view, df.toPandas())
    assert plain(found.toPandas(), found.columns) == plain(db.sql(sql).df(), found.columns)


def test_quotation_links(spark):
    df = spark.createDataFrame(MESSAGES, SCHEMA)
    found = quotes.reply_ordered(df.withColumn("thread", df["role"]).withColumn("depth", df["role"]))
    rows = {(r["conv_id"], r["turn"], r["text"]): r for r in found.collect()}
    assert len(rows) == len(MESSAGES)
    assert rows[(1, 1, "Fine, thanks.")]["reply_to"] == 0 and rows[(1, 2, "Good!")]["reply_to"] == 1
    assert rows[(1, 4, "ok")]["quoted"] is False and rows[(1, 4, "ok")]["reply_to"] == 3
    assert rows[(1, 5, "yes")]["thread"] == 0 and rows[(1, 5, "yes")]["depth"] == 3 and rows[(1, 5, "yes")]["place"] == 6
    assert rows[(1, 4, "ok")]["thread"] == 0 and rows[(1, 4, "ok")]["depth"] == 2 and rows[(3, 5000, "b")]["depth"] == 2
    same_as_sql(df, found, quotes.SQL, "conversations")


def test_quotation_links_at_random(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 9)):
            own = " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 3)))
            quoted = "".join(f"{'> ' * rng.randint(1, 3)}{rng.choice(said)}\n" for _ in range(rng.randint(0, 2)) if said)
            said.append(own)
            rows.append((conv, turn * rng.choice([1, 1, 600]) if turn else 0, "user", quoted + own))
    df = spark.createDataFrame(rows, SCHEMA)
    same_as_sql(df, quotes.reply_ordered(df), quotes.SQL, "conversations")


def test_long_messages_and_deep_quotes(spark):
    lines = [f"line {i} of many" for i in range(100_000)]
    rows = [
        (1, 0, "u", ">" * 100_000 + " deep"),
        (1, 1, "u", "\n".join(lines)),
        (1, 2, "u", "\n".join("> " * (1 + i % 2) + x for i, x in enumerate(lines)) + "\nanswer"),
        (1, 3, "u", "> " * 50_000 + "answer\n" + "x " * 100_000),
    ]
    found = {r["turn"]: r for r in quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[0]["text"] == "" and found[2]["text"] == "answer" and len(found[1]["text"]) == len("\n".join(lines))
    assert found[2]["reply_to"] == 1 and not found[2]["quoted"] and found[3]["reply_to"] == 2 and found[3]["quoted"]


def test_ranges_are_even_whatever_the_turns(spark, monkeypatch):
    """One turn far from all others does not put those into one range."""
    monkeypatch.setattr(quotes, "BLOCK", 100)
    turns = [(1, t, None) for t in range(2000)] + [(1, 10**12, 5), (2, 7, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, quoted long")
    seen = {}
    kept = quotes.materialize
    monkeypatch.setattr(quotes, "materialize", lambda d, label: seen.setdefault(label, kept(d, label)))
    got = {(r["conv_id"], r["turn"]): r for r in quotes.in_order(df).collect()}
    assert max(r["count"] for r in seen["ranges"].groupBy("block").count().collect()) <= 400
    assert all(got[1, t]["place"] == t + 1 and got[1, t]["before"] == (t - 1 if t else None) and got[1, t]["first"] == 0 for t in range(2000))
    far = got[1, 10**12]
    assert (far["place"], far["before"], far["head"], far["head_place"]) == (2001, 1999, 10**12, 2001) and got[2, 7]["place"] == 1


def test_hot_conversation_in_blocks(spark, monkeypatch):
    """Few turns a block, turns far apart, repeated rows: the blocks join to one order."""
    monkeypatch.setattr(quotes, "BLOCK", 4)
    rng, rows, said = random.Random(8), [], []
    for i in range(200):
        turn = i * 1_000_003 if i < 150 else 10**15 + i
        quoted = f"> {rng.choice(said)}\n" if said and rng.random() < 0.3 else ""
        said.append(f"say {i}")
        rows += [(7, turn, "u", quoted + said[-1])] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, SCHEMA)
    same_as_sql(df, quotes.reply_ordered(df), quotes.SQL, "conversations")


def test_quotation_links_of_nothing(spark):
    assert quotes.reply_ordered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_licenses(spark, edge_docs, clashing, empty_docs):
    mit = licenses.KNOWN_TEXTS[1][1]
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + mit),
        (2, ("The MIT Licence\n" + mit).upper()),
        (3, mit.replace("sublicense", "sub-licence").replace("\n", "  ")),
        (4, None),
        (5, ""),
        (5, ""),
        (6, "some words\nLICENSED under the Apache Licence version 2.0\nReleased under the MIT License.\nReleased under the MIT license"),
        (7, mit + " and more"),
        (8, "Copyright (c) 2021 Someone\n" + dict(licenses.KNOWN_TEXTS)["BSL-1.0"].replace(". ", ".\n").replace("license", "licence")),
        (9, "# header\n\n" + licenses._GNU_HEADER.format("General Public License").replace("the ", "the\n") + "\n\ntext\n" + "more " * 50_000),
        (10, "licence licence licence"),
        (11, "license license license"),
        (12, "x\nCopyright 2020 Me\nlicensed under the Apache License, Version 2.0\n\n\n"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan(df, licenses.built_in(spark))
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == 13
    assert by_id[8]["license"] == "BSL-1.0" and by_id[9]["notices"] == "GPL-3.0-or-later" and by_id[10]["text_digest"] == by_id[11]["text_digest"] and by_id[12]["notices"] == "Apache-2.0"
    assert by_id[1]["license"] == "MIT" and by_id[7]["license"] is None and by_id[4]["text_digest"] is None
    assert by_id[6]["notices"] == "Apache-2.0,MIT" and by_id[6]["n_notices"] == 3
    same_as_sql(df, found, licenses.sql(), "documents")
    known = licenses.built_in(spark)
    assert licenses.scan(edge_docs, known).count() == 12 and licenses.scan(clashing, known).count() == 12 and licenses.scan(empty_docs, known).count() == 0
