"""Every registered query at the smallest scale, against its SQL where it has one."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import NAMES, compare

RUNS, SQL = entry.queries(), entry.oracle_sql()
# 36 fits; test_learners.py runs benchmarks of its own.
SLOW = {"j39_run_benchmark"}


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in RUNS if n not in SLOW])
def test_query(spark, con, data, name):
    verdict, _ = compare(spark, con, name, RUNS[name], SQL.get(name), data)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["task_type"] == "classification"
    assert row["recommended_model"] == "Random Forest"
    assert row["n_samples"] == 1500
