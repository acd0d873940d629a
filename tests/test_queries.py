"""Every registered query of the library against its SQL in another engine, on the smallest test tables."""

from __future__ import annotations

import datetime
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from dossier.plans import catalogue, files, fonts, further, identities, issuers, item_tables, keeping, layout, more, papers, reports, rules, sequences, values  # noqa: F401  registers all queries
from dossier.plans.tables import NAMES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for name in NAMES:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, float, np.number)):
        return round(float(value), 6)
    if isinstance(value, (datetime.date, pd.Timestamp)):
        return str(value).replace(" 00:00:00", "")
    return str(value)


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_lockout_stream_against_plain_windows(spark):
    from dossier.storage import read_table

    got = {(r["user_id"], r["first_failure"], r["failures"]) for r in catalogue.QUERIES["stream_login_lockout"](spark, SF).collect()}
    events = read_table(spark, SF, "events").filter("event_type IN ('error', 'purchase')").toPandas().sort_values(["ts", "event_id"])
    want = set()
    for user, own in events.groupby("user_id"):
        started, n = None, 0
        for ts, kind in zip(own["ts"], own["event_type"], strict=True):
            if kind != "error":
                started, n = None, 0
                continue
            if started is None or (ts - started).total_seconds() > 86400:
                started, n = ts, 0
            n += 1
            if n == 3:
                want.add((user, started.to_pydatetime(), 3))
                started, n = None, 0
    assert got == want


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.FLAGSHIP in __spark_entry__.queries()
