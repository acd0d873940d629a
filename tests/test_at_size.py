"""What shows in larger tables only: keys of more digits, sizes that the planner guesses too low, plans that shuffle little."""

from __future__ import annotations

import duckdb
import pytest
from test_queries import rows

from dossier.plans import catalogue
from dossier.storage import measured_broadcasts

SF = "/root/testdata/sf0.001"


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Does a query say the same as its SQL over tables made by SQL from those of sf0.001?"""

    def check(name, **tables):
        db = duckdb.connect()
        for table, sql in tables.items():
            db.sql(f"COPY ({sql.format(table=f"'{SF}/{table}.parquet'")}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        got, want = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), db.sql(catalogue.ORACLE_SQL[name]).df()
        columns = sorted(want.columns)
        assert len(want) and sorted(got.columns) == columns
        assert rows(got, columns) == rows(want, columns)

    return check


def test_addresses_of_customers_with_six_digit_keys(same_as_sql):
    same_as_sql("fn_compare_addresses", customer="SELECT * REPLACE (c_custkey * 6257 AS c_custkey) FROM {table}")


def test_what_an_explode_makes_is_not_broadcast_for_its_guessed_size(spark):
    """The planner takes a table of variants to be as small as the fingerprints that they are made of."""
    from dossier.llm import simhash

    prints = spark.range(1000).selectExpr("xxhash64(id) AS f0")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan(simhash.stars(prints, 3))
    with measured_broadcasts(spark):
        assert "BroadcastHashJoin" not in plan(simhash.stars(prints, 3))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_near_dedup_broadcasts_nothing_unmeasured(spark, monkeypatch):
    from dossier import storage
    from dossier.llm import simhash

    texts = [" ".join(f"w{(i // 2) * 7 + k}" for k in range(40)) + (" end" if i % 2 else "") for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans, table = [], storage.Scratch.table

    def written(self, df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, label)

    monkeypatch.setattr(storage.Scratch, "table", written)
    monkeypatch.setattr(simhash, "broadcast_if_small", lambda df: df)
    assert simhash.deduplicate(docs).count() == 30
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


@pytest.mark.parametrize("name", ["parse_multi_column_table", "parse_single_row_table", "parse_stacked_table"])
def test_tables_are_parsed_without_joins_or_sorted_cells(spark, name):
    """Joins of exploded cells with headers were sized as the orders, and every step dealt out all cells anew."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_tables_of_a_repeated_order(same_as_sql):
    same_as_sql("parse_multi_column_table", orders="SELECT * FROM {table} WHERE o_orderkey < 50 UNION ALL SELECT * REPLACE (o_totalprice + 1 AS o_totalprice) FROM {table} WHERE o_orderkey < 20")


def test_order_agreement_keeps_its_grid_small(spark, monkeypatch):
    """Counts of blocks by blocks grow with the square of the blocks, so these are bounded, not their rows."""
    import random

    from pyspark.sql import functions as F

    from dossier import storage
    from dossier.operators import sequences

    monkeypatch.setattr(sequences, "MOST_BLOCKS", 8, raising=False)
    rng, cells, table = random.Random(3), [], storage.Scratch.table

    def written(self, df, label):
        out = table(self, df, label)
        if label == "cells":
            cells.append(out.count())
        return out

    monkeypatch.setattr(storage.Scratch, "table", written)
    values = [rng.random() for _ in range(400)]
    got = sequences.order_agreement(spark.createDataFrame(list(enumerate(values)), "i int, v double"), [F.col("i")], [F.col("v")], 5).first()
    assert got["discordant"] == sum(values[i] > values[j] for i in range(400) for j in range(i + 1, 400)) and got["n"] == 400
    assert cells and cells[0] <= 64


def test_only_names_and_addresses_are_looked_up(spark, monkeypatch):
    """Values that differ in every case, as incomes and numbers do, were made distinct, written and joined back."""
    from dossier.operators import contradictions

    rows = [(1, i, "t", field, value, None, False) for field, values in {"full_name": ["Ravi Khan", "Seema Khan"], "annual_income": ["100", "900"], "id_number": ["1234", "9999"], "address": ["1 Lake Road", "2 Lake Road"]}.items() for i, value in enumerate(values)]
    written = {}
    table = contradictions.materialize
    monkeypatch.setattr(contradictions, "materialize", lambda df, label: written.setdefault(label, table(df, label)))
    fields = spark.createDataFrame(rows, "case_id int, document_id int, document_type string, field string, value string, currency string, uncertain boolean")
    got = contradictions.identity_contradictions(fields).select("field", "reason", "severity").collect()
    assert sorted(map(tuple, got)) == [("address", "address_difference", "low"), ("annual_income", "income_difference", "critical"), ("full_name", "different_name", "critical"), ("id_number", "id_number_difference", "high")]
    assert set(written) == {"classes", "judged"} and {r["field"] for r in written["judged"].collect()} == {"full_name", "address"}


def test_merged_items_are_dealt_out_once(spark):
    """Every window and join of the merge dealt out all items anew."""
    from dossier.operators import item_tables

    items = "document_id long, place int, source string, description string, line_total double"
    old = spark.createDataFrame([(1, 1, "llm", "a", 5.0, 7), (1, 2, "table", "b", 6.0, 8), (1, 3, "llm", "c", None, 9), (None, 1, "llm", "d", 5.0, 1), (2, 1, "llm", "x", 5.0, 2)], items + ", box int")
    new = spark.createDataFrame([(1, 1, "table", "b", 6.0), (1, 2, "table", "n", 5.0), (1, 3, "table", "n", 5.0), (1, 4, "table", "m", 5.0), (1, 5, "table", "e", None), (None, 1, "table", "d", 5.0)], items)
    merged = item_tables.merge_line_items(old, new)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = sorted((tuple(r) for r in merged.collect()), key=repr)
    assert got == sorted([
        (1, 1, "table", "n", 5.0, 7), (1, 2, "table", "b", 6.0, 8), (1, 3, "llm", "c", None, 9), (1, 4, "table", "m", 5.0, None), (1, 5, "table", "e", None, None),
        (2, 1, "llm", "x", 5.0, 2), (None, 1, "llm", "d", 5.0, 1), (None, 2, "table", "d", 5.0, None),
    ], key=repr)
