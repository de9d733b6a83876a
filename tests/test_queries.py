"""Every core query against its SQL on the smallest test data; queries without SQL have to run."""

import datetime
from pathlib import Path

import duckdb
import pytest

from plotmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings scan_history scan_inbox scan_mirror tracker_additions reports tracker_lines gazetteer eval_items mix_targets".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
