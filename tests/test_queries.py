"""Every query of the core against its SQL, on the smallest data."""

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from mnemora.queries.registry import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def one(v):
        if isinstance(v, Decimal):
            v = float(v)
        if isinstance(v, float):
            return None if v != v else repr(v + 0.0)
        return v if v is None else str(v)

    return [columns[k] for k in order], Counter(str([one(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not glob.glob(f"{FOLDER}/*.parquet"), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        cursor = con.execute(ORACLES[name])
        assert got == canon([d[0] for d in cursor.description], cursor.fetchall())
