"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries whose groups differ with the size of the tables.
BOTH = ["page_roots", "subtree_stats", "tree_heads", "tree_entries", "list_nodes"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")


@pytest.fixture(scope="module")
def duck():
    opened = {}

    def at(folder):
        if folder not in opened:
            opened[folder] = con = duckdb.connect()
            for t in TABLES:
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return opened[folder]

    yield at
    for con in opened.values():
        con.close()


def text(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("folder, name", [(FOLDER, n) for n in sorted(QUERIES)] + [(LARGER, n) for n in BOTH])
def test_query(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    rows = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    found = duck(folder).execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert rows == want


@pytest.mark.parametrize("name", ["doc_snapshot_all", "doc_poll_all"])
def test_whole_document_reads_stay_on_spark(spark, monkeypatch, name):
    """No rows come to the driver, and the plan does not grow with the pages of the table."""

    def refuse(self):
        raise AssertionError("rows collected on the driver")

    with monkeypatch.context() as patched:
        patched.setattr(type(spark.range(1)), "collect", refuse)
        df = QUERIES[name](spark, FOLDER)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1
    assert "Sort" not in df._jdf.queryExecution().executedPlan().toString()
