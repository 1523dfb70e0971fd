"""Registered queries next to their SQL, on small tables of their own."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pairscape.checks import QUERIES
from pairscape.checks.compare import compare


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Districts of three splits with gaps in their calendars."""
    path = tmp_path_factory.mktemp("tables")
    customers = [(k, nation) for nation in (1, 13, 16) for k in range(100 * nation, 100 * nation + 3)]
    orders = [
        (0, key, dt.datetime(1996 + key % 3, 1 + (5 * key + 7 * i) % 12, 3), 100.0 * key + 37.5 * i, "1-URGENT" if (key + i) % 3 else "5-LOW")
        for key, _ in customers for i in range(6)
    ]
    tables = {
        "nation": {"n_nationkey": pa.array(range(25), pa.int32()), "n_name": [f"NATION_{i}" for i in range(25)]},
        "customer": {"c_custkey": [k for k, _ in customers], "c_nationkey": pa.array([n for _, n in customers], pa.int32())},
        "orders": {
            "o_orderkey": list(range(len(orders))), "o_custkey": [o[1] for o in orders], "o_orderdate": pa.array([o[2] for o in orders], pa.timestamp("us")),
            "o_totalprice": [o[3] for o in orders], "o_orderpriority": [o[4] for o in orders],
        },
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), path / f"{name}.parquet")
    return str(path)


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = compare(spark, con, QUERIES[name], folder)
    assert found["ok"], found
    return found["rows"]


def test_train_stats_are_verified(spark, folder):
    assert same_as_sql(spark, folder, "A22_verify_train_stats") > 20


@pytest.mark.parametrize("name,shuffles", [("W4_spatial_sample", 0), ("R12_per_pair_sampling", 0), ("R12_sampling_report", 1)])
def test_patches_are_sampled_where_their_pair_lies(spark, folder, name, shuffles):
    """Pairs are shuffled before their grids are made, patches are not; the report shuffles its numbers by pair."""
    assert same_as_sql(spark, folder, name) > 10
    plan = QUERIES[name].spark(spark, folder)._jdf.queryExecution().executedPlan().toString().splitlines()
    by_id = [line for line in plan if "hashpartitioning(pair_id" in line or "hashpartitioning(patch_id" in line]
    assert sum("ENSURE_REQUIREMENTS" in line for line in by_id) == shuffles


@pytest.mark.parametrize("name", ["A3_train_stats", "A4_impute_scale", "R18_audit_status"])
def test_statistics_of_all_columns(spark, folder, name):
    """The feature table is not turned into a row for each value, which the former passes did."""
    made = []
    from pairscape.operators import tabular

    long_values = tabular.long_values
    tabular.long_values = lambda *a, **k: made.append(1) or long_values(*a, **k)
    try:
        assert same_as_sql(spark, folder, name) > 0
    finally:
        tabular.long_values = long_values
    assert not made
