from pathlib import Path

import duckdb
import pytest

from tilespan.llm import queries

SF = "/root/testdata/sf0.01"


def test_every_oracle_is_sql():
    assert all(isinstance(sql, str) for sql in queries.ORACLES.values())


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, SF)
    names = sorted(d[0] for d in want.description)
    assert names == sorted(found.columns)
    rows = ", ".join(names)
    assert sorted(map(tuple, found.select(names).collect()), key=repr) == sorted(db.sql(f"SELECT {rows} FROM want").fetchall(), key=repr)
