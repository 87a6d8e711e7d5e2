"""Every bound query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from orebody.plans import bindings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return None if v != v or str(v) in ("NaT", "<NA>") else v


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(spark, duck, name):
    got = bindings.QUERIES[name](spark, SF)
    want = duck.execute(bindings.SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    order = sorted(cols)
    at = [cols.index(c) for c in order]
    a = sorted(str([plain(r[c]) for c in order]) for r in got.collect())
    b = sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
    assert a == b


def test_entry_needs_no_other_package(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


WHOLE = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(WHOLE), reason="needs the test tables")
@pytest.mark.parametrize("name", ["reverse_pointers", "tree_ancestors", "lowest_common_ancestor", "bin_summary"])
def test_whole_tables(spark, name):
    """At this size a subset of the ids would show."""
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{WHOLE}/{t}.parquet'")
    got, want = bindings.QUERIES[name](spark, WHOLE), c.execute(bindings.SQL[name])
    order = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(k) for k in order]
    rows = want.fetchall()
    assert sorted(str([plain(r[k]) for k in order]) for r in got.collect()) == sorted(str([plain(r[i]) for i in at]) for r in rows)
    if name == "bin_summary":
        assert sum(r[1] for r in rows) >= c.execute("select count(*) from events").fetchone()[0]
    else:
        assert len(rows) > {"reverse_pointers": 1000, "tree_ancestors": 230, "lowest_common_ancestor": 200}[name]
