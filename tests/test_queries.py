import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from sessionloom.plans import catalogue

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}'")
    return con


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple("NULL" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.skipif(not SF.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, str(SF)).toPandas()
    if name in catalogue.SQL:
        want = con.sql(catalogue.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_registry_without_training_data_operators():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())
