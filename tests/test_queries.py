"""Queries against their SQL twins and contract columns on the smallest tables."""

import os

import pytest

from skirmish.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
COLUMNS = {
    "p1_found": "log_id target start_ts end_ts duration_s n_events",
    "p2_found": "log_id first_line last_line entry_ts log_level component",
    "p3_found": "log_id entity event_type n_events total_amount last_seen",
}


def plain(v):
    return round(v, 9) if isinstance(v, float) else v if v is None or isinstance(v, int | str) else str(v)


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        path = f"{SF}/{t}" + ("/*.parquet" if os.path.isdir(f"{SF}/{t}") else "")
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, tables, name):
    df, rel = registry.QUERIES[name](spark, SF), tables.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    assert mine == sorted((tuple(plain(v) for v in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    assert registry.QUERIES[name](spark, SF).columns == COLUMNS[name].split()


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
