"""Every audit query against DuckDB on the smallest tables; queries without SQL must run."""

import pytest

from evenhand.registry import QUERIES, SQL
from evenhand.sources.fixtures import TABLES

SLOW = {"linear_probe", "probe_null_control", "probe_table", "perceptron_probe"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = got[cols].sort_values(cols).reset_index(drop=True)
    b = want[cols].sort_values(cols).reset_index(drop=True)
    assert len(a) == len(b)
    for c in cols:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), (c, a[c][~same].head(3).tolist(), b[c][~same].head(3).tolist())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_query_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and len(rows) == len(set(map(str, rows)))
    for r in rows:  # figures are in the ranges that their names promise
        for name, low, high in (("p", 0, 1), ("p_fdr", 0, 1), ("p_bonferroni", 0, 1), ("pct", 0, 100), ("cramers_v", 0, 1)):
            value = r.asDict().get(name)
            assert value is None or value != value or low <= value <= high


def test_queries_keep_the_operators_settings(spark, sf_dir, monkeypatch):
    from evenhand import registry

    called = []
    monkeypatch.setattr(registry.pr, "probe", lambda *a, **options: called.append(options))
    QUERIES["linear_probe"](spark, sf_dir)
    QUERIES["probe_null_control"](spark, sf_dir)
    assert called == [{}, {}]
    assert QUERIES["poisson_bootstrap"](spark, sf_dir).first()["n_boot"] == 200
    assert {"hd95_vb", "hd95_disc"} <= set(QUERIES["case_scores"](spark, sf_dir).columns)


def test_entry_registers_everything():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
