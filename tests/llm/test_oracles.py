import sys
from pathlib import Path

import duckdb
import pytest

from tessera.llm.queries import ORACLES, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check import compare  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_beside_its_sql(spark, name):
    oracle = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations", "labels", "embeddings"):
        oracle.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    problem, n_rows = compare(QUERIES[name](spark, SF), oracle, ORACLES[name])
    assert not problem and n_rows > 0
