"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    got = registry.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = oracle.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]}) _t").fetchall()
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(want)
    spark.catalog.clearCache()
