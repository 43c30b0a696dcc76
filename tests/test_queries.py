"""Each registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quillspark.plans import casework, layouts, letters, recognition, records, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the synthetic tables are not here")


def norm(value):
    if isinstance(value, float):
        return f"{0.0 if value == 0 else value:.9g}" if math.isfinite(value) else str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    frame = registry.QUERIES[name](spark, SF)
    cursor = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    got, want = rows_of(frame.columns, frame.collect()), rows_of(names, cursor.fetchall())
    assert got[:5] == want[:5] and got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
