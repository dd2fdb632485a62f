"""Every query whose SQL twin is known gives its rows, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from mnemora.plans import ledger, memory, workflows  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def shown(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        number = df[c].dtype.kind == "f"
        df[c] = [("none" if x is None or pd.isna(x) else f"{x:.6f}".rstrip("0").rstrip(".") if number else str(x)) for x in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(memory.QUERIES))
def test_query(spark, con, name):
    got = memory.QUERIES[name](spark, SF).toPandas()
    if name in memory.ORACLE_SQL:
        pd.testing.assert_frame_equal(shown(got), shown(con.sql(memory.ORACLE_SQL[name]).df()))


def test_entry_module_names_every_query():
    import __spark_entry__ as entry

    assert set(memory.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
