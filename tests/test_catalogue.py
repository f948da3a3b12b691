"""Every registered query that has a DuckDB twin gives its rows; plans have no window over the whole table."""

from decimal import Decimal

import duckdb
import pytest

from reelspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "conversations", "lineitem", "labels", "benchmark", "orders", "pages"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(float(v), 4) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v
    return sorted(str(tuple(plain(r[k]) for k in order)) for r in values)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def test_no_global_window(spark):
    for name in ("percentile_bands", "molecule_rank", "timeline_offsets", "consensus_ranks", "scene_thinning"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name
