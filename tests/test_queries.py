"""Every route query that SQL can express against DuckDB on the smallest tables; the others have rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pathloom.plans import more_queries

SF = "/root/testdata/sf0.001"
ROUTES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def db():
    own = duckdb.connect()
    for t in os.listdir(SF):
        own.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return own


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ROUTES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name not in entry.oracle_sql():
        assert rows
        return
    found = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns) and plain(rows, df.columns) == plain(found.fetchall(), columns)


def test_shortcut_completion_asks_for_all_active_pairs(spark):
    _, active, found = more_queries._mined(spark, SF)
    active = [r["edge"] for r in active.collect()]
    known = {(r["src"], r["dst"]) for r in more_queries.shortcuts.medoids(found).collect()}
    rows = entry.queries()["shortcut_completion"](spark, SF).collect()
    assert sorted((r["src"], r["dst"]) for r in rows) == sorted((a, b) for a in active for b in active if a != b and (a, b) not in known)
    assert max(r["src"] for r in rows) >= 30


def test_entry(spark):
    assert entry.entry(spark).count() == 1
