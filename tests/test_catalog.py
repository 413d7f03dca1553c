"""Each query against its SQL on DuckDB, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from sparkloom.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, data, name):
    mine, theirs = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    if name == "shortest_path_len" and theirs["length"].isna().all():  # no path: SQL has a null, we count no nodes
        assert mine["length"].tolist() == [-1]
        return
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize(("buyer", "length"), [(1, 2), (2, 6), (None, None)])
def test_path_length_is_that_of_sql_with_and_without_a_path(spark, tmp_path, buyer, length):
    con = duckdb.connect()
    tables = {
        "region": "SELECT 1 AS r_regionkey",
        "nation": "SELECT unnest([1, 2]) AS n_nationkey, 1 AS n_regionkey",
        "customer": "SELECT unnest([1, 2]) AS c_custkey, unnest([1, 2]) AS c_nationkey",
        "supplier": "SELECT 1 AS s_suppkey, 1 AS s_nationkey",
        "orders": f"SELECT unnest([5, 2]) AS o_orderkey, unnest([1, {'NULL' if buyer is None else buyer}]) AS o_custkey",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    mine = [tuple(r) for r in QUERIES["shortest_path_len"](spark, str(tmp_path)).collect()]
    assert mine == con.execute(ORACLES["shortest_path_len"]).fetchall() == [(length,)]
