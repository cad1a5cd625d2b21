"""Every core query against its SQL in DuckDB, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from tracewright.plans import queries as core

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(core.every_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = core.every()[name](spark, FOLDER)
    names = sorted(df.columns)
    found = duck.execute(core.every_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]

    def order(rows):
        return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])

    assert order([r[c] for c in names] for r in df.collect()) == order([r[i] for i in at] for r in found.fetchall())


def test_results_are_not_empty(spark):
    """Queries whose answer on these tables could have been nothing."""
    for name in ("cycle_edges", "counter_sums_common", "critical_cycles", "incremental_periods", "transformation_intervals", "burst_clusters"):
        assert core.queries()[name](spark, FOLDER).count() > 0, name


def test_entry_module_lists_all_core_queries():
    import __spark_entry__

    assert set(core.queries()) <= set(__spark_entry__.queries())
    assert set(core.oracle_sql()) <= set(__spark_entry__.oracle_sql())
