"""Every registered key against its DuckDB oracle on the small scale factor."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from tokenloom.sources.tables import TABLES

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_spec = importlib.util.spec_from_file_location("check_oracle", os.path.join(HERE, "scripts", "check_oracle.py"))
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)

KEYS = sorted(entry_mod.oracle_sql())


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, small, duck, key):
    sdf = entry_mod.queries()[key](spark, small)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(entry_mod.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert check.type_mismatches(sdf, res.description) == []
    assert len(srows) == len(drows)
    assert check.rows_of(sdf.columns, srows) == check.rows_of(dcols, drows)
