import duckdb
import pytest

from lodestone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    frame = queries.queries()[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(map(tuple, frame.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)
