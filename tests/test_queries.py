"""Every named query over the derived reads against its SQL in DuckDB."""

import math

import duckdb
import pytest

from strandspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = norm(df.select(*columns).toLocalIterator())
    want = norm(duck.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({catalog.ORACLE[name]})").fetchall())
    assert got == want


def test_range_join_has_no_nested_loop(spark, capsys):
    catalog.QUERIES["q_region_reads"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
