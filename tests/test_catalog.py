"""Every registered query of the engine's own operators against its SQL, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from dagloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted([tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False, name=None)], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_agrees(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_critical_path_known_value(spark):
    last = catalog.critical_path(spark, SF).orderBy("pos").collect()[-1]
    assert (last.node_id, last.cost) == ("135", 154)
