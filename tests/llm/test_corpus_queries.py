import os

import pytest

from skirmish.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
COLUMNS = {
    "p4_found": "log_id enc_id metric fighter category source_name pet rank_no",
    "p5_found": "field term n_events n_encounters mark",
    "p6_found": "attacker pct amount",
    "p7_packing": "container doc_id piece n_tokens",
    "p8_found": "doc_id item_id",
    "p9_found": "doc_id sentence",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_keys(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name].split()
    assert df.count() == df.distinct().count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        path = f"{SF}/{t}" + ("/*.parquet" if os.path.isdir(f"{SF}/{t}") else "")
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted(rel.select(*[f'"{c}"' for c in cols]).fetchall(), key=repr)
