import duckdb
import pytest

from strata.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_sharding"])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    rows = want.select(", ".join(got.columns)).fetchall()
    assert sorted(map(repr, rows)) == sorted(map(repr, (tuple(r) for r in got.collect())))
