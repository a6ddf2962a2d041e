from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import (
    calendar_spine,
    month_bounds,
    month_name,
    month_start,
    shift_month,
    year_bounds,
)
from tallyhouse.operators import rollup
from tallyhouse.plans import views

from tests.conftest import TESTDATA

DAILY = "day date, trips bigint, revenue double, km double"
TRIPS = "t string, fare_eur double, distance_km double"
D = date(2010, 1, 1)


def _trips(rows, *values):
    return rows(TRIPS, *values).withColumn("trip_date", F.col("t").cast("timestamp_ntz"))


def _daily(rows, *trips):
    return rows(DAILY, *[(D + timedelta(i), n, n * 2.0, n * 0.5) for i, n in enumerate(trips)])


# --- rollup and KPIs ---------------------------------------------------------------


def test_daily_rollup(rows):
    trips = _trips(
        rows,
        ("2009-12-31 23:59:59", 9.0, 9.0),
        ("2010-01-02 08:00:00", 1.10, 1.0),
        ("2010-01-02 23:59:59", 2.20, None),
        ("2010-01-01 00:00:00", None, 3.5),
        ("2011-01-01 00:00:00", 9.0, 9.0),
        (None, 9.0, 9.0),
    )
    out = rollup.daily_rollup(trips, *year_bounds(2010)).collect()
    assert [tuple(r) for r in out] == [(date(2010, 1, 1), 1, 0.0, 3.5), (date(2010, 1, 2), 2, 3.3, 1.0)]


def test_filled_days_have_no_gap(rows):
    daily = rows(DAILY, (date(2012, 2, 28), 2, 1.0, 1.0), (date(2013, 1, 1), 5, 5.0, 5.0))
    out = rollup.fill_days(daily, *year_bounds(2012)).collect()
    assert len(out) == 366
    assert [r.day for r in out] == [date(2012, 1, 1) + timedelta(i) for i in range(366)]
    assert sum(r.trips for r in out) == 2


def test_the_two_month_kpis_differ_by_missing_fares(rows):
    trips = _trips(rows, ("2010-01-01 01:00:00", 10.0, 2.0), ("2010-01-01 02:00:00", None, 4.0))
    month = month_bounds(2010, 1)
    per_trip = rollup.month_kpi_per_trip(trips, *month).head()
    ratio = rollup.month_kpi_ratio(rollup.daily_rollup(trips, *month)).head()
    assert tuple(per_trip) == (2, 10.0, 3.0) and tuple(ratio) == (2, 5.0, 3.0)


def test_month_kpis_of_an_empty_month(rows):
    trips, month = _trips(rows), month_bounds(2010, 1)
    assert tuple(rollup.month_kpi_per_trip(trips, *month).head()) == (0, None, None)
    ratio = rollup.month_kpi_ratio(rollup.daily_rollup(trips, *month)).head()
    assert tuple(ratio) == (0, 0.0, 0.0)


def test_period_summary(rows):
    assert tuple(rollup.period_summary(_daily(rows, 1, 2, 6)).head()) == (
        3, 9, 18.0, 4.5, 3.0, 6.0, 1.5,
    )
    assert tuple(rollup.period_summary(rows(DAILY)).head()) == (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_route_mean_fare(rows):
    taxi = rows(
        "pickup_zip int, dropoff_zip int, fare_amount double",
        (1, 2, 10.0), (1, 2, 11.0), (1, 2, None), (2, 1, 50.0), (3, 3, None),
    )
    assert tuple(rollup.route_mean_fare(taxi, 1, 2).head()) == (3, 10.5)
    assert tuple(rollup.route_mean_fare(taxi, 9, 9).head()) == (0, 99.0)
    assert tuple(rollup.route_mean_fare(taxi, 3, 3).head()) == (1, None)


# --- ranking and rolling -----------------------------------------------------------


def test_ranked_days_break_ties_by_day_and_put_missing_last(rows):
    daily = rows(
        "day date, revenue double",
        (D, 5.0), (D + timedelta(1), None), (D + timedelta(2), 7.0), (D + timedelta(3), 7.0),
        (D + timedelta(4), float("nan")),
    )
    best = [r.revenue for r in rollup.ranked_days(daily, "revenue", 4).collect()]
    worst = [r.revenue for r in rollup.ranked_days(daily, "revenue", 4, ascending=True).collect()]
    assert best == [7.0, 7.0, 5.0, None] and worst == [5.0, 7.0, 7.0, None]
    assert rollup.ranked_days(daily, "revenue").head().day == D + timedelta(2)


@pytest.mark.parametrize("count, left", [(0, 0), (6, 0), (7, 1), (20, 14)])
def test_rolling_mean_needs_a_full_frame(rows, count, left):
    out = rollup.rolling_mean(_daily(rows, *range(count))).collect()
    assert len(out) == left
    assert [r.trips for r in out] == [i + 3.0 for i in range(left)]


def test_a_missing_value_empties_every_frame_it_is_in(rows):
    days = [(D + timedelta(i), i, None if i == 3 else 1.0, 1.0) for i in range(12)]
    out = rollup.rolling_mean(rows(DAILY, *days))
    assert [r.day for r in out.collect()] == [D + timedelta(i) for i in (10, 11)]
    assert rollup.rolling_mean(rows(DAILY, *days), ["trips"]).count() == 6


def test_rolling_mean_counts_rows_not_days(rows):
    days = [(D + timedelta(10 * i), 7, 7.0, 7.0) for i in range(7)]
    assert rollup.rolling_mean(rows(DAILY, *days)).count() == 1


# --- comparisons -------------------------------------------------------------------


def test_month_compare_crosses_the_year(rows):
    trips = _trips(
        rows,
        ("2009-12-31 10:00:00", 10.0, 1.0), ("2010-01-05 10:00:00", 12.5, 0.5),
        ("2010-01-06 10:00:00", 12.5, 0.5), ("2010-02-01 00:00:00", 99.0, 9.0),
        ("2009-11-30 10:00:00", 99.0, 9.0),
    )
    r = rollup.month_compare(trips, date(2010, 1, 1)).head()
    assert (r.trips, r.trips_prev, r.trips_pct) == (2, 1, 100.0)
    assert (r.revenue, r.revenue_prev, r.revenue_pct) == (25.0, 10.0, 150.0)
    assert (r.km, r.km_prev, r.km_pct) == (1.0, 1.0, 0.0)


def test_change_is_null_without_a_previous_month(rows):
    trips = _trips(rows, ("2010-01-05 10:00:00", 1.0, 1.0))
    r = rollup.month_compare(trips, date(2010, 1, 1)).head()
    assert (r.trips_prev, r.trips_pct, r.revenue_prev, r.revenue_pct) == (0, None, 0.0, None)


def test_all_months_do_not_look_across_a_missing_one(rows):
    trips = _trips(
        rows, ("2010-01-05 10:00:00", 1.0, 1.0), ("2010-03-05 10:00:00", 2.0, 1.0),
        ("2010-04-05 10:00:00", 3.0, 1.0), (None, 5.0, 5.0),
    )
    out = rollup.month_compare_all(trips).collect()
    assert [(r.month.month, r.revenue_prev, r.revenue_pct) for r in out] == [
        (1, 0.0, None), (3, 0.0, None), (4, 2.0, 50.0),
    ]


def test_one_month_agrees_with_all_months(spark):
    trips = views.trips(spark, f"{TESTDATA}/sf0.001")
    every = {r.month: r for r in rollup.month_compare_all(trips).collect()}
    for month in (min(every), date(1996, 1, 1), date(1996, 3, 1), max(every)):
        assert rollup.month_compare(trips, month).head() == every[month]


# --- calendar ----------------------------------------------------------------------


def test_months_shift_to_the_first_day_both_ways(rows):
    assert shift_month(date(2010, 1, 31), -1) == date(2009, 12, 1)
    assert shift_month(date(2010, 12, 5), 1) == date(2011, 1, 1)
    assert shift_month(date(2010, 6, 5), -18) == date(2008, 12, 1)
    r = rows("d date", (date(2010, 1, 31),)).select(
        month_start(F.col("d")).alias("a"), month_start(F.col("d"), -1).alias("b"),
        month_start(F.col("d"), 13).alias("c"), month_name(F.col("d")).alias("n"),
    ).head()
    assert tuple(r) == (date(2010, 1, 1), date(2009, 12, 1), date(2011, 2, 1), "Janeiro")


def test_spine(spark):
    assert calendar_spine(spark, *year_bounds(2011)).count() == 365
    assert calendar_spine(spark, *year_bounds(2012)).count() == 366
    weeks = calendar_spine(spark, date(2010, 2, 5), date(2010, 2, 5) + timedelta(weeks=120), 7)
    assert weeks.count() == 120 and weeks.agg(F.max("day").alias("d")).head().d == date(2012, 5, 18)
    assert calendar_spine(spark, D, D).count() == 0


def test_rolling_means_are_exact_and_do_not_depend_on_what_came_before(rows):
    from datetime import timedelta
    from fractions import Fraction

    values = [1e14, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 1e-9, 2.5, None, 1.0, 1 / 3, 7.0]
    first = date(2024, 1, 1)
    frame = rows("day date, x double", *[(first + timedelta(i), v) for i, v in enumerate(values)])
    found = {r.day: r.x for r in rollup.rolling_mean(frame, ["x"], rows=3).collect()}
    for i in range(2, len(values)):
        window = values[i - 2 : i + 1]
        expected = None if None in window else float(sum(Fraction(str(v)) for v in window)) / 3
        assert found.get(first + timedelta(i)) == expected, i


def test_rolling_means_of_values_too_large_for_decimals(rows):
    from datetime import timedelta

    frame = rows("day date, x double", *[(date(2024, 1, 1) + timedelta(i), v) for i, v in enumerate([1e30, 2e30, 3.0, 6.0, 9.0])])
    found = [r.x for r in rollup.rolling_mean(frame, ["x"], rows=2).orderBy("day").collect()]
    assert found == [(1e30 + 2e30) / 2, (2e30 + 3.0) / 2, 4.5, 7.5]
