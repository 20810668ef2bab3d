"""Every registered query beside its SQL at the smallest scale."""
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check import compare  # noqa: E402

from tessera.workload.catalogue import ORACLES, QUERIES  # noqa: E402
from tessera.workload.inputs import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    problem, n_rows = compare(QUERIES[name](spark, SF), oracle, ORACLES.get(name))
    assert not problem
    assert n_rows > 0
