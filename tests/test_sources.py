import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyhouse.sources import tables

from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"


def test_load_prefers_the_catalog_and_else_reads_the_path(spark, rows):
    rows("x int", (1,)).createOrReplaceTempView("known_table")
    assert tables.load(spark, "known_table", f"{SF}/orders.parquet").columns == ["x"]
    assert "o_orderkey" in tables.load(spark, "no_such_table", f"{SF}/orders.parquet").columns
    spark.catalog.dropTempView("known_table")


def test_load_never_makes_up_data(spark):
    with pytest.raises(LookupError):
        tables.load(spark, "no_such_table")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load(spark, "no_such_table", f"{SF}/missing.parquet")


def test_query_binds_values_instead_of_splicing_them(spark, rows):
    frame = rows("s string", ("a' OR 'x'='x",), ("b",))
    found = tables.query(spark, "SELECT s FROM {t} WHERE s = :s", {"s": "a' OR 'x'='x"}, t=frame)
    assert found.count() == 1
    with pytest.raises(TypeError):
        tables.query(spark, "SELECT :s", {"s": object()})


def test_daily_sql_takes_the_half_open_range(spark, rows):
    trips = rows(
        "t string, fare_eur double, distance_km double",
        ("1995-12-31 23:59:59", 1.0, 1.0), ("1996-01-01 00:00:00", 2.0, 1.0),
        ("1996-12-31 23:59:59", 3.0, 1.0), ("1997-01-01 00:00:00", 4.0, 1.0),
    ).withColumn("trip_date", F.col("t").cast("timestamp_ntz"))
    found = tables.daily_sql(spark, trips, date(1996, 1, 1), date(1997, 1, 1)).collect()
    assert [(r.day, r.revenue) for r in found] == [(date(1996, 1, 1), 2.0), (date(1996, 12, 31), 3.0)]


def test_sample_without_order_stops_reading_and_with_order_is_fixed(spark):
    ids = spark.range(0, 100_000, numPartitions=16)
    assert tables.bounded_sample(ids, 7).count() == 7
    shuffled = ids.orderBy(F.rand(1))
    assert [r.id for r in tables.bounded_sample(shuffled, 5, ["id"]).collect()] == list(range(5))
    assert tables.bounded_sample(ids.limit(3), 5, ["id"]).count() == 3


def test_normalise(rows):
    frame = rows(
        "Date string, x double, y float, z int",
        ("2010-02-05", 1.0, 2.0, 1),
        ("2010-02-05 10:30:00", math.nan, math.nan, None),
        ("2010-02-05 soon", None, None, 2),
        ("soon", 3.0, None, 3),
        (None, 4.0, 5.0, 4),
    )
    out = tables.normalise(frame, rename={"Date": "sale_date"})
    assert dict(out.dtypes)["sale_date"] == "date"
    assert [tuple(r) for r in out.collect()] == [
        (date(2010, 2, 5), 1.0, 2.0, 1),
        (date(2010, 2, 5), None, None, None),
        (None, None, None, 2),
        (None, 3.0, None, 3),
        (None, 4.0, 5.0, 4),
    ]


def test_normalise_without_the_date_column_is_no_error(rows):
    assert tables.normalise(rows("x int", (1,))).collect()[0].x == 1


def test_normalise_timestamp_and_other_types(rows):
    frame = rows("t string, n int", ("2010-02-05 10:30:00", 20100205))
    frame = frame.withColumn("sale_date", F.col("t").cast("timestamp_ntz"))
    assert tables.normalise(frame).head().sale_date == date(2010, 2, 5)
    assert tables.normalise(frame, dates=["n"]).head().n is None
