"""Every registered query against its SQL twin, and the plans they run with."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyhouse.functions.calendar import year_bounds
from tallyhouse.operators import rollup, sales
from tallyhouse.plans import views
from tallyhouse.sources import tables

from tests.conftest import TESTDATA
from tests.oracle import compare, connect

SF = f"{TESTDATA}/sf0.001"
QUERIES = {k: v for k, v in entry.queries().items() if k not in entry.LLM_QUERIES}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _scan(frame):
    """Full text of the scans: filters and schema are cut short in the plan's tree."""
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry_gives_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["day", "trips", "revenue", "km"] and frame.count() == 345


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    plan = _plan(frame)
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert compare(frame, duck, ORACLES[name]) is None


def test_the_rollup_reads_three_columns_of_one_year(spark):
    scan = _scan(QUERIES["daily_rollup"](spark, SF))
    assert re.search(
        r"PushedFilters: \[IsNotNull\(l_shipdate\), GreaterThanOrEqual\(l_shipdate,1996-01-01"
        r".*LessThan\(l_shipdate,1997-01-01", scan
    )
    assert "struct<l_quantity:double,l_extendedprice:double,l_shipdate:timestamp_ntz>" in scan


def test_sums_are_combined_before_the_shuffle(spark):
    plan = _plan(rollup.daily_totals(views.trips(spark, SF), *year_bounds(1996)))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
    assert plan.index("Exchange") < plan.rindex("HashAggregate")


def test_top_lists_do_not_sort_everything(spark):
    for name in ("top_stores", "top_offenders", "best_days", "bounded_sample"):
        plan = _plan(QUERIES[name](spark, SF))
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_queries_that_ignore_the_logs_do_not_build_them(spark):
    for name in ("set_shares", "sales_trend", "top_stores", "zone_effect"):
        assert "to_json" not in _scan(QUERIES[name](spark, SF)).lower()


def test_labelled_rows_are_counted_without_reading_json_again(spark):
    for name in ("dq_split", "rule_hits_errors"):
        assert "json" not in _scan(QUERIES[name](spark, SF)).lower()


def test_first_rows_cost_one_scan_and_no_shuffle_of_keys(spark):
    for name in ("bounded_sample", "quarantine_examples"):
        plan = _plan(QUERIES[name](spark, SF))
        assert plan.count("FileScan") == 1 and "hashpartitioning" not in plan


def test_no_window_is_without_partition_but_over_days(spark):
    for name, build in QUERIES.items():
        plan = _plan(build(spark, SF))
        for window in re.findall(r"Window \[.*", plan):
            assert "rolling7" in name or not re.search(r"windowspecdefinition\(\w+#\d+ (ASC|DESC)", window), name


def test_both_sets_cost_one_scan(spark):
    labelled = views.labelled_sales(spark, SF)
    for frame in (sales.set_kpis(labelled), sales.sales_trend(labelled), sales.holiday_effect(labelled)):
        assert _plan(frame).count("FileScan") == 1


def test_results_do_not_depend_on_the_partitioning(spark):
    labelled = views.labelled_sales(spark, SF)
    again = labelled.repartition(13, F.rand(3))
    for operator in (sales.set_kpis, sales.sales_trend, sales.holiday_effect):
        assert sorted(operator(labelled).collect()) == sorted(operator(again).collect())


def test_a_catalog_table_is_read_by_partition(spark):
    frame = QUERIES["catalog_month_kpi"](spark, SF)
    scan = _scan(frame)
    assert re.search(r"PartitionFilters: \[.*month#\d+ >= 1996-03-01.*month#\d+ < 1996-04-01", scan)
    frame.collect()
    metrics = frame._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet spark_catalog.default.trips_" in metrics
    months = frame.sparkSession.sql(f"SHOW PARTITIONS {re.search('trips_[0-9a-f]{32}', scan)[0]}").count()
    assert months > 12


def test_a_table_is_not_stored_over_another(spark, tmp_path):
    trips = views.trips(spark, SF).limit(3)
    tables.store_by_month(trips, "stored_once", f"{tmp_path}/a", "trip_date")
    with pytest.raises(ValueError):
        tables.store_by_month(trips, "stored_once", f"{tmp_path}/b", "trip_date")
    assert tables.load(spark, "stored_once").count() == 3
    spark.sql("DROP TABLE stored_once")
