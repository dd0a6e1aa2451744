"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    problem, _, _ = compare(spark, con, entry.queries()[name], SQL.get(name), SF)
    assert problem == ""


def test_page_cut_deals_lines_once_in_parts_of_bounded_size(spark, monkeypatch):
    from rollcall.catalog import reading

    monkeypatch.setattr(reading, "ROWS_PER_PART", 100)
    found = reading.page_cut(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    deals = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert deals and all(f", {lines // 100}), REPARTITION_BY_NUM" in x for x in deals)
    assert found.count() > 0
