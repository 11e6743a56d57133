"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
import queries as registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = db.execute(entry.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in cur.description}
    place = [[d[0] for d in cur.description].index(c) for c in cols] if sorted(kinds) == cols else None
    assert place is not None, (cols, sorted(kinds))
    want = _sorted([tuple(_plain(r[i]) for i in place) for r in cur.fetchall()])
    got = _sorted([tuple(_plain(r[c]) for c in cols) for r in df.collect()])
    assert len(got) == len(want)
    assert got == want
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"namespace", "rule", "tick", "state"} <= set(df.columns)
    assert df.limit(1).count() == 1
