"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from millrace.plans import catalog, checks, evals, gates, reviews, rules, scores, texts  # noqa: F401  (they add to the catalog)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(map(repr, duck.sql(f"SELECT {quoted} FROM ({catalog.ORACLES[name]})").fetchall()))
    assert got == want


def test_entry_points_are_complete(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "lang", "source"]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
