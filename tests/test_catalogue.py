"""Each registered query against its SQL twin, as the driver compares them."""

import os

import duckdb
import pytest

from quarry.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return tuple((k, plain(v)) for k, v in x.asDict().items())
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got or name in ORACLES, "no rows"
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall())
        assert got == want
