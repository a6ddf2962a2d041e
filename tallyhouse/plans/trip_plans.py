"""Registered queries on trips, each with its SQL twin."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import month_bounds, month_name, month_start, year_bounds
from tallyhouse.functions.lineage import checkpoint_folder
from tallyhouse.functions.text import change_text, km_text, money_text, whole_text
from tallyhouse.operators import rollup
from tallyhouse.operators.frames import (
    DAILY_METRICS,
    chosen_metrics,
    pair,
    present_columns,
)
from tallyhouse.plans import views
from tallyhouse.sources import tables

YEAR = 1996
MONTH = date(1996, 3, 1)
YEAR_CROSSING = date(1996, 1, 1)
ROUTE = (7, 3)
NO_ROUTE = (-1, -1)

QUERIES = {}
ORACLES = {}


def _query(oracle: str, name: str | None = None):
    def register(build):
        key = name or build.__name__
        QUERIES[key] = build
        ORACLES[key] = oracle
        return build

    return register


def _total(column: str) -> str:
    return f"CAST(COALESCE(SUM(CAST({column} AS DECIMAL(18,2))), 0) AS DOUBLE)"


def _mean(column: str) -> str:
    return f"{_total(column)} / NULLIF(COUNT({column}), 0)"


_YEAR_RANGE = f"trip_date >= DATE '{YEAR}-01-01' AND trip_date < DATE '{YEAR + 1}-01-01'"
_MONTH_RANGE = "trip_date >= DATE '1996-03-01' AND trip_date < DATE '1996-04-01'"


def _daily_sql(where: str) -> str:
    return f"""
SELECT CAST(trip_date AS DATE) AS day, COUNT(*) AS trips,
       {_total("fare_eur")} AS revenue, {_total("distance_km")} AS km
FROM trips_v WHERE {where} GROUP BY 1"""


def _over_daily(body: str, where: str = _YEAR_RANGE) -> str:
    return views.oracle(body, trips_v=views.TRIPS, daily=_daily_sql(where))


def _year(spark, sf_dir) -> DataFrame:
    return rollup.daily_totals(views.trips(spark, sf_dir), *year_bounds(YEAR))


def _month(spark, sf_dir) -> DataFrame:
    return rollup.daily_totals(
        views.trips(spark, sf_dir), *month_bounds(MONTH.year, MONTH.month)
    )


# --- sources and projections -------------------------------------------------------


@_query(views.oracle(f"""
SELECT CAST(trip_date AS DATE) AS day, COUNT(*) AS trips,
       ROUND(SUM(fare_eur), 2) AS revenue, ROUND(SUM(distance_km), 2) AS km
FROM trips_v WHERE {_MONTH_RANGE} GROUP BY 1""", trips_v=views.TRIPS))
def sql_source_month(spark, sf_dir):
    """Daily table of a month from SQL text with bound parameters."""
    daily = tables.daily_sql(
        spark, views.trips(spark, sf_dir), *month_bounds(MONTH.year, MONTH.month)
    )
    return daily.select(
        "day", "trips", F.round("revenue", 2).alias("revenue"), F.round("km", 2).alias("km")
    )


@_query(views.oracle(f"""
SELECT COUNT(*) AS trips, ROUND(AVG(fare_eur), 4) AS avg_fare, ROUND(AVG(distance_km), 4) AS avg_km
FROM trips_v WHERE {_MONTH_RANGE}""", trips_v=views.TRIPS_WITH_GAPS))
def sql_source_month_kpi(spark, sf_dir):
    """Month KPI from SQL text with bound parameters."""
    gaps = views.view(spark, sf_dir, views.TRIPS_WITH_GAPS, "lineitem")
    kpi = tables.month_sql(spark, gaps, *month_bounds(MONTH.year, MONTH.month))
    return kpi.select(
        "trips", F.round("avg_fare", 4).alias("avg_fare"), F.round("avg_km", 4).alias("avg_km")
    )


@_query(views.oracle("""
SELECT * FROM trips_v
ORDER BY trip_date, fare_eur, distance_km, pickup_zip, dropoff_zip LIMIT 5000""",
    trips_v=views.TRIPS))
def bounded_sample(spark, sf_dir):
    """The first 5,000 trips in a fixed order."""
    trips = views.trips(spark, sf_dir)
    return tables.bounded_sample(trips, 5000, trips.columns)


@_query(views.oracle("SELECT trip_distance, fare_amount FROM taxi_v", taxi_v=views.TAXI))
def fare_by_distance(spark, sf_dir):
    """Distance and fare of every trip."""
    taxi = views.view(spark, sf_dir, views.TAXI, "lineitem")
    return pair(taxi, "trip_distance", "fare_amount")


@_query(views.oracle("SELECT fare_eur, trip_date FROM trips_v", trips_v=views.TRIPS),
    "present_columns")
def present_columns_of_trips(spark, sf_dir):
    """The wanted columns that exist; one of the wanted ones does not."""
    return present_columns(views.trips(spark, sf_dir), ["fare_eur", "tip_eur", "trip_date"])


@_query(_over_daily("SELECT day, revenue, km FROM daily"), "chosen_metrics")
def chosen_metrics_of_year(spark, sf_dir):
    """Two chosen metrics of the daily table."""
    return chosen_metrics(_year(spark, sf_dir), ["revenue", "km"])


# --- rollups -----------------------------------------------------------------------


@_query(_over_daily("SELECT * FROM daily"))
def daily_rollup(spark, sf_dir):
    """Trips, revenue and distance per day of a year."""
    return rollup.daily_rollup(views.trips(spark, sf_dir), *year_bounds(YEAR))


@_query(_over_daily(f"""
SELECT CAST(s.day AS DATE) AS day, COALESCE(d.trips, 0) AS trips,
       COALESCE(d.revenue, 0) AS revenue, COALESCE(d.km, 0) AS km
FROM (SELECT unnest(generate_series(TIMESTAMP '{YEAR}-01-01', TIMESTAMP '{YEAR}-12-31',
                                    INTERVAL 1 DAY)) AS day) s
LEFT JOIN daily d ON d.day = CAST(s.day AS DATE)"""))
def daily_rollup_filled(spark, sf_dir):
    """Daily table with a zero row for each day without trips."""
    return rollup.fill_days(_year(spark, sf_dir), *year_bounds(YEAR))


@_query(views.oracle(f"""
SELECT COUNT(*) AS trips, {_mean("fare_eur")} AS avg_fare, {_mean("distance_km")} AS avg_km
FROM trips_v WHERE {_MONTH_RANGE}""", trips_v=views.TRIPS_WITH_GAPS))
def month_kpi_per_trip(spark, sf_dir):
    """Month KPI over the trips that have a fare."""
    gaps = views.view(spark, sf_dir, views.TRIPS_WITH_GAPS, "lineitem")
    return rollup.month_kpi_per_trip(gaps, *month_bounds(MONTH.year, MONTH.month))


@_query(views.oracle(f"""
SELECT COUNT(*) AS trips, COALESCE({_total("fare_eur")} / NULLIF(COUNT(*), 0), 0) AS avg_fare,
       COALESCE({_total("distance_km")} / NULLIF(COUNT(*), 0), 0) AS avg_km
FROM trips_v WHERE {_MONTH_RANGE}""", trips_v=views.TRIPS_WITH_GAPS))
def month_kpi_ratio(spark, sf_dir):
    """Month KPI over all trips, from the daily table."""
    gaps = views.view(spark, sf_dir, views.TRIPS_WITH_GAPS, "lineitem")
    return rollup.month_kpi_ratio(
        rollup.daily_totals(gaps, *month_bounds(MONTH.year, MONTH.month))
    )


@_query(views.oracle(f"""
SELECT COUNT(*) AS trips, {_mean("fare_eur")} AS avg_fare, {_mean("distance_km")} AS avg_km
FROM trips_v WHERE {_MONTH_RANGE}""", trips_v=views.TRIPS_WITH_GAPS))
def catalog_month_kpi(spark, sf_dir):
    """Month KPI of a table found by its name in the catalog, of which one partition is read."""
    name = f"trips_{uuid.uuid4().hex}"
    gaps = views.view(spark, sf_dir, views.TRIPS_WITH_GAPS, "lineitem")
    tables.store_by_month(gaps, name, f"{checkpoint_folder(spark)}/{name}", "trip_date")
    bounds = month_bounds(MONTH.year, MONTH.month)
    return rollup.month_kpi_per_trip(tables.load_months(spark, name, *bounds, "trip_date"), *bounds)


@_query(_over_daily("""
SELECT CAST(s.day AS DATE) AS week, COALESCE(SUM(d.trips), 0)::BIGINT AS trips
FROM (SELECT unnest(generate_series(TIMESTAMP '1995-12-25', TIMESTAMP '1997-01-06',
                                    INTERVAL 7 DAY)) AS day) s
LEFT JOIN daily d ON d.day >= CAST(s.day AS DATE) AND d.day < CAST(s.day AS DATE) + 7
GROUP BY 1"""))
def weekly_trips_filled(spark, sf_dir):
    """Trips per week (by its Monday) with a zero for each week of the spine without trips."""
    return rollup.weekly_trips(_year(spark, sf_dir), date(1995, 12, 25), date(1997, 1, 13))


_SUMMARY = f"""
SELECT COUNT(*) AS days, CAST(COALESCE(SUM(trips), 0) AS BIGINT) AS trips_total,
       {_total("revenue")} AS revenue_total, {_total("km")} AS km_total,
       COALESCE({_mean("trips")}, 0) AS trips_avg, COALESCE({_mean("revenue")}, 0) AS revenue_avg,
       COALESCE({_mean("km")}, 0) AS km_avg
FROM daily"""


@_query(_over_daily(_SUMMARY))
def year_summary(spark, sf_dir):
    """Totals and daily means of a year."""
    return rollup.period_summary(_year(spark, sf_dir))


@_query(_over_daily(_SUMMARY, _MONTH_RANGE))
def month_summary(spark, sf_dir):
    """Totals and daily means of one month."""
    return rollup.period_summary(_month(spark, sf_dir))


def _route_sql(pickup: int, dropoff: int) -> str:
    return views.oracle(f"""
SELECT COUNT(*) AS trips,
       CASE WHEN COUNT(*) = 0 THEN 99 ELSE {_mean("fare_amount")} END AS mean_fare
FROM taxi_v WHERE pickup_zip = {pickup} AND dropoff_zip = {dropoff}""", taxi_v=views.TAXI)


@_query(_route_sql(*ROUTE))
def route_mean_fare(spark, sf_dir):
    """Mean fare of a route with trips."""
    return rollup.route_mean_fare(views.view(spark, sf_dir, views.TAXI, "lineitem"), *ROUTE)


@_query(_route_sql(*NO_ROUTE))
def route_mean_fare_default(spark, sf_dir):
    """Default fare of a route without trips."""
    return rollup.route_mean_fare(views.view(spark, sf_dir, views.TAXI, "lineitem"), *NO_ROUTE)


# --- ranking and rolling -----------------------------------------------------------


@_query(_over_daily("SELECT * FROM daily ORDER BY revenue DESC, day LIMIT 5"))
def best_days(spark, sf_dir):
    """The five days with the highest revenue."""
    return rollup.ranked_days(_year(spark, sf_dir), "revenue", 5)


@_query(_over_daily("SELECT * FROM daily ORDER BY trips, day LIMIT 1"))
def worst_days(spark, sf_dir):
    """The day with the fewest trips."""
    return rollup.ranked_days(_year(spark, sf_dir), "trips", 1, ascending=True)


def rolling_sql(metric: str) -> str:
    """Mean over the window ``w`` of the exact decimal sum."""
    exact = f"CAST(CAST({metric} AS VARCHAR) AS DECIMAL(38,18))"
    return f"CAST(SUM({exact}) OVER w AS DOUBLE) / 7 AS {metric}"


_ROLLING = f"""
SELECT day, trips, revenue, km FROM (
  SELECT day, COUNT(*) OVER w AS n, {", ".join(map(rolling_sql, DAILY_METRICS))}
  FROM daily {{where}} WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
WHERE n = 7"""


@_query(_over_daily(_ROLLING.format(where="")))
def rolling7_year(spark, sf_dir):
    """Seven-row rolling means of a year."""
    return rollup.rolling_mean(_year(spark, sf_dir))


@_query(_over_daily(_ROLLING.format(where="WHERE month(day) = 3")))
def rolling7_month(spark, sf_dir):
    """Seven-row rolling means within one month: its first six rows have none."""
    march = rollup.daily_totals(views.trips(spark, sf_dir), *month_bounds(MONTH.year, MONTH.month))
    return rollup.rolling_mean(march)


# --- comparisons -------------------------------------------------------------------

_CHANGES = ", ".join(
    f"{m}, {m}_prev, ({m} - {m}_prev) / NULLIF({m}_prev, 0) * 100.0 AS {m}_pct"
    for m in DAILY_METRICS
)


def _compare_sql(month: date) -> str:
    now = f"DATE '{month}'"
    sums = ", ".join(
        f"{_total(f'CASE WHEN {condition} THEN {column} END')} AS {name}"
        for column, metric in (("fare_eur", "revenue"), ("distance_km", "km"))
        for condition, name in (
            (f"trip_date >= {now}", metric), (f"trip_date < {now}", f"{metric}_prev"))
    )
    return views.oracle(f"""
SELECT {now} AS month, {_CHANGES} FROM (
  SELECT COUNT(*) FILTER (trip_date >= {now}) AS trips,
         COUNT(*) FILTER (trip_date < {now}) AS trips_prev, {sums}
  FROM trips_v WHERE trip_date >= {now} - INTERVAL 1 MONTH
                 AND trip_date < {now} + INTERVAL 1 MONTH)""", trips_v=views.TRIPS)


@_query(_compare_sql(MONTH))
def month_compare(spark, sf_dir):
    """A month against the one before."""
    return rollup.month_compare(views.trips(spark, sf_dir), MONTH)


@_query(_compare_sql(YEAR_CROSSING))
def month_compare_january(spark, sf_dir):
    """January against December of the year before."""
    return rollup.month_compare(views.trips(spark, sf_dir), YEAR_CROSSING)


@_query(views.oracle(f"""
SELECT m.month, {", ".join(
    f"m.{x} AS {x}, COALESCE(p.{x}, 0) AS {x}_prev, "
    f"(m.{x} - p.{x}) / NULLIF(p.{x}, 0) * 100.0 AS {x}_pct" for x in DAILY_METRICS)}
FROM monthly m LEFT JOIN monthly p ON p.month = CAST(m.month - INTERVAL 1 MONTH AS DATE)""",
    trips_v=views.TRIPS, monthly=f"""
SELECT CAST(date_trunc('month', trip_date) AS DATE) AS month, COUNT(*) AS trips,
       {_total("fare_eur")} AS revenue, {_total("distance_km")} AS km
FROM trips_v GROUP BY 1"""))
def month_compare_all(spark, sf_dir):
    """Every month against the one before."""
    return rollup.month_compare_all(views.trips(spark, sf_dir))


@_query(views.oracle("""
SELECT DISTINCT CAST(date_trunc('month', trip_date) AS DATE) AS month,
  list_value('Janeiro', 'Fevereiro', 'Março', 'Abril', 'Maio', 'Junho', 'Julho', 'Agosto',
             'Setembro', 'Outubro', 'Novembro', 'Dezembro')[month(trip_date)] AS label,
  CAST(date_trunc('month', trip_date) - INTERVAL 1 MONTH AS DATE) AS previous,
  CAST(date_trunc('month', trip_date) + INTERVAL 1 MONTH AS DATE) AS next,
  CAST(date_trunc('month', trip_date) - INTERVAL 14 MONTH AS DATE) AS fourteen_before
FROM trips_v""", trips_v=views.TRIPS))
def month_labels(spark, sf_dir):
    """The months that have trips, their names and neighbours."""
    months = views.trips(spark, sf_dir).select(
        month_start(F.col("trip_date")).alias("month")
    ).distinct()
    month = F.col("month")
    return months.select(
        "month",
        month_name(month).alias("label"),
        month_start(month, -1).alias("previous"),
        month_start(month, 1).alias("next"),
        month_start(month, -14).alias("fourteen_before"),
    )


# --- texts -------------------------------------------------------------------------


def _money_sql(x: str) -> str:
    return f"'€ ' || translate(format('{{:,.2f}}', {x}), ',.', ' ,')"


def _km_sql(x: str) -> str:
    return f"translate(format('{{:,.1f}}', {x}), ',.', ' ,') || ' km'"


def _whole_sql(x: str) -> str:
    return f"translate(format('{{:,}}', {x}), ',', ' ')"


@_query(_over_daily(f"""
SELECT {_whole_sql("trips_total")} AS trips, {_money_sql("revenue_total")} AS revenue,
       {_km_sql("km_total")} AS km, {_money_sql("revenue_avg")} AS revenue_per_day,
       {_km_sql("km_avg")} AS km_per_day FROM ({_SUMMARY})"""))
def kpi_text(spark, sf_dir):
    """Year summary as text."""
    return year_summary(spark, sf_dir).select(
        whole_text(F.col("trips_total")).alias("trips"),
        money_text(F.col("revenue_total")).alias("revenue"),
        km_text(F.col("km_total")).alias("km"),
        money_text(F.col("revenue_avg")).alias("revenue_per_day"),
        km_text(F.col("km_avg")).alias("km_per_day"),
    )


_COMPARED = ORACLES["month_compare_all"]


@_query(f"""
SELECT month, {_whole_sql("trips")} AS trips, {_money_sql("revenue")} AS revenue,
       {_km_sql("km")} AS km, {", ".join(
           f"COALESCE(CASE WHEN {x}_pct >= 0 THEN '+' ELSE '' END || format('{{:.1f}}', {x}_pct)"
           f" || '%', '—') AS {x}_change" for x in DAILY_METRICS)}
FROM ({_COMPARED})""")
def kpi_text_compare(spark, sf_dir):
    """Every month's totals and changes as text."""
    return month_compare_all(spark, sf_dir).select(
        "month",
        whole_text(F.col("trips")).alias("trips"),
        money_text(F.col("revenue")).alias("revenue"),
        km_text(F.col("km")).alias("km"),
        *[change_text(F.col(f"{m}_pct")).alias(f"{m}_change") for m in DAILY_METRICS],
    )
