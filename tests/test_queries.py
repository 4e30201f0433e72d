"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("entry_module", ROOT / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(df):
    """Columns by name, one comparable text per cell, rows in any order."""
    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) or x is pd.NA:
            return "null"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, float, np.number)):
            return repr(float(x))
        return str(x)

    columns = sorted(df.columns)
    return columns, sorted(tuple(map(cell, row)) for row in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = canonical(QUERIES[name](spark, SF).toPandas()), canonical(duck.execute(ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
