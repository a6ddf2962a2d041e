"""Trip metrics: daily rollup, month KPIs, summaries, comparisons, rolling means."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import calendar_spine, month_start, shift_month
from tallyhouse.functions.numbers import (
    exact_mean,
    exact_sum,
    identifier,
    known,
    number_sql,
    percent_change,
)
from tallyhouse.operators.frames import (
    DAILY_METRICS,
    day_of,
    drop_missing,
    equal_pair,
    half_open,
)

ROLLING_ROWS = 7
_PREFIX = "DECIMAL(37,18)"  # two of these are subtracted without losing a digit
NO_ROUTE_FARE = 99.0  # fixed value: shown where a route has no trips


def daily_totals(
    trips: DataFrame,
    start: date,
    end: date,
    date_column: str = "trip_date",
    fare: str = "fare_eur",
    km: str = "distance_km",
) -> DataFrame:
    """Trips, revenue and distance per day of ``[start, end)``, in no order.

    One scan with map-side sums: the shuffle carries one row per day and task, also
    when one day holds a third of the trips. Days without trips are absent. This is
    the table to summarise, rank or smooth further; none of that needs it sorted.
    """
    return (
        half_open(trips, date_column, start, end)
        .groupBy(day_of(F.col(date_column)).alias("day"))
        .agg(
            F.count("*").alias("trips"),
            exact_sum(number_sql(trips, fare)).alias("revenue"),
            exact_sum(number_sql(trips, km)).alias("km"),
        )
    )


def daily_rollup(trips: DataFrame, start: date, end: date, **columns: str) -> DataFrame:
    """``daily_totals`` in day order, for display."""
    return daily_totals(trips, start, end, **columns).orderBy("day")


def fill_days(daily: DataFrame, start: date, end: date) -> DataFrame:
    """Daily table with a zero row for every day of ``[start, end)`` that has none."""
    zeros = calendar_spine(daily.sparkSession, start, end).select(
        "day", F.lit(0).cast("bigint").alias("trips"), F.lit(0.0).alias("revenue"), F.lit(0.0).alias("km")
    )
    rows = half_open(daily, "day", start, end).select(*zeros.columns).unionByName(zeros)
    return rows.groupBy("day").agg(*[F.sum(m).alias(m) for m in DAILY_METRICS]).orderBy("day")


def weekly_trips(daily: DataFrame, start: date, end: date) -> DataFrame:
    """Trips per week over a spine of every seventh day from ``start`` to before ``end``.

    A week is named by its first day, and one without trips has 0. Days outside are left out.
    """
    zeros = calendar_spine(daily.sparkSession, start, end, 7, "week").withColumn("trips", F.lit(0).cast("bigint"))
    since = F.datediff("day", F.lit(start))
    week = F.date_add(F.lit(start), (F.floor(since / 7) * 7).cast("int")).alias("week")
    rows = half_open(daily, "day", start, end).select(week, "trips").unionByName(zeros)
    return rows.groupBy("week").agg(F.sum("trips").alias("trips")).orderBy("week")


def month_kpi_per_trip(
    trips: DataFrame,
    start: date,
    end: date,
    date_column: str = "trip_date",
    fare: str = "fare_eur",
    km: str = "distance_km",
) -> DataFrame:
    """Trip count and means over the trips that have a value; NULL means for no trips."""
    return half_open(trips, date_column, start, end).agg(
        F.count("*").alias("trips"),
        exact_mean(number_sql(trips, fare)).alias("avg_fare"),
        exact_mean(number_sql(trips, km)).alias("avg_km"),
    )


def month_kpi_ratio(daily: DataFrame) -> DataFrame:
    """Trip count and ratio of the sums over all trips; 0 for no trips.

    Unlike ``month_kpi_per_trip``, a trip without a fare counts in the denominator.
    """
    trips = F.coalesce(F.sum("trips"), F.lit(0).cast("bigint"))

    def ratio(metric: str) -> Column:
        return F.coalesce(F.try_divide(exact_sum(metric), trips), F.lit(0.0))

    return daily.agg(
        trips.alias("trips"), ratio("revenue").alias("avg_fare"), ratio("km").alias("avg_km")
    )


def period_summary(daily: DataFrame) -> DataFrame:
    """Days, totals and means of the daily values; all zero for an empty table."""
    zero = F.lit(0.0)
    return daily.agg(
        F.count("*").alias("days"),
        F.coalesce(F.sum("trips"), F.lit(0).cast("bigint")).alias("trips_total"),
        exact_sum("revenue").alias("revenue_total"),
        exact_sum("km").alias("km_total"),
        F.coalesce(exact_mean("CAST(trips AS DOUBLE)"), zero).alias("trips_avg"),
        F.coalesce(exact_mean("revenue"), zero).alias("revenue_avg"),
        F.coalesce(exact_mean("km"), zero).alias("km_avg"),
    )


def route_mean_fare(
    trips: DataFrame,
    pickup: int,
    dropoff: int,
    fare: str = "fare_amount",
    default: float = NO_ROUTE_FARE,
) -> DataFrame:
    """Mean fare between two zip codes; ``default`` where no trip matches."""
    route = equal_pair(trips, ("pickup_zip", pickup), ("dropoff_zip", dropoff))
    return route.agg(
        F.count("*").alias("trips"),
        F.when(F.count("*") == 0, F.lit(default))
        .otherwise(exact_mean(number_sql(trips, fare)))
        .alias("mean_fare"),
    )


def ranked_days(daily: DataFrame, metric: str, n: int = 1, ascending: bool = False) -> DataFrame:
    """The ``n`` best (or, ascending, worst) days; ties go to the earlier day."""
    key = known(F.col(metric).cast("double"))
    key = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    return daily.orderBy(key, "day").limit(n)


def rolling_mean(
    daily: DataFrame,
    metrics: Sequence[str] = DAILY_METRICS,
    rows: int = ROLLING_ROWS,
    by: Sequence[str] = (),
    order: str = "day",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Mean of each metric over a row and the ``rows - 1`` before it.

    Counts rows, not calendar days. A row is kept only if every metric has a full
    frame without NULLs. Sums are differences of two exact prefix sums of the values as
    decimals, so a mean does not depend on what was added before it. Where a frame
    holds a value that is no decimal of ``_PREFIX`` it is added up as doubles.
    For one series (``by`` empty) the window is a single task:
    give it a daily table, whose size the calendar bounds, never facts.
    """
    ordered = Window.partitionBy(*by).orderBy(order)
    frame = ordered.rowsBetween(1 - rows, Window.currentRow)
    until = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = daily.select(*by, order, *keep, *metrics)
    for i, m in enumerate(metrics):
        amount = F.expr(f"try_cast({identifier(m)} AS {_PREFIX})")
        summed = summed.withColumn(f"_exact{i}", F.when(amount.cast("double") == F.col(m).cast("double"), amount))
    summed = summed.withColumns({f"_until{i}": F.try_sum(f"_exact{i}").over(until) for i in range(len(metrics))})
    summed = summed.withColumns({f"_until{i}": F.expr(f"try_cast(_until{i} AS {_PREFIX})") for i in range(len(metrics))})
    means = []
    for i, m in enumerate(metrics):
        before = F.coalesce(F.lag(f"_until{i}", rows).over(ordered), F.lit(0).cast(_PREFIX))
        total = (F.col(f"_until{i}") - before).cast("double")
        exact = (F.count(f"_exact{i}").over(frame) == rows) & total.isNotNull()
        mean = F.when(exact, total / rows).otherwise(F.avg(m).over(frame))
        means.append(F.when(F.count(m).over(frame) == rows, mean).alias(m))
    return drop_missing(summed.select(*by, order, *keep, *means), metrics)


def month_compare(
    trips: DataFrame,
    month: date,
    date_column: str = "trip_date",
    fare: str = "fare_eur",
    km: str = "distance_km",
) -> DataFrame:
    """Totals of a month and of the one before, with the change in percent.

    Both months are read in one range scan and told apart by conditional sums, also
    where the earlier one lies in the year before. The change is NULL where the
    earlier total is 0.
    """
    current, previous, end = (shift_month(month, k) for k in (0, -1, 1))
    is_current = f"{identifier(date_column)} >= DATE'{current}'"
    totals = [
        F.expr(f"count_if({is_current})").alias("trips"),
        F.expr(f"count_if(NOT {is_current})").alias("trips_prev"),
    ]
    for name, value in {"revenue": number_sql(trips, fare), "km": number_sql(trips, km)}.items():
        now = f"CASE WHEN {is_current} THEN {value} END"
        before = f"CASE WHEN NOT {is_current} THEN {value} END"
        totals += [exact_sum(now).alias(name), exact_sum(before).alias(f"{name}_prev")]
    result = half_open(trips, date_column, previous, end).agg(*totals)
    return result.select(F.lit(current).alias("month"), *_with_change(DAILY_METRICS))


def month_compare_all(
    trips: DataFrame,
    date_column: str = "trip_date",
    fare: str = "fare_eur",
    km: str = "distance_km",
) -> DataFrame:
    """``month_compare`` for every month that has trips.

    Months are rolled up straight from the facts; the look-back runs on that monthly
    table. A month whose predecessor has no trips compares with 0.
    """
    monthly = (
        trips.filter(F.col(date_column).isNotNull())
        .groupBy(month_start(F.col(date_column)).alias("month"))
        .agg(
            F.count("*").alias("trips"),
            exact_sum(number_sql(trips, fare)).alias("revenue"),
            exact_sum(number_sql(trips, km)).alias("km"),
        )
    )
    # Every month stands for itself and, one month on, for the one before: no window over all.
    roles = F.array(
        F.struct(F.col("month").alias("at"), F.lit(True).alias("own")),
        F.struct(F.add_months("month", 1).alias("at"), F.lit(False).alias("own")),
    )
    both = monthly.select("*", F.inline(roles)).groupBy(F.col("at").alias("month"))
    values = {}
    for metric in DAILY_METRICS:
        zero = F.lit(0).cast("bigint") if metric == "trips" else F.lit(0.0)
        values[metric] = F.max(F.when(F.col("own"), F.col(metric)))
        values[f"{metric}_prev"] = F.coalesce(F.max(F.when(~F.col("own"), F.col(metric))), zero)
    compared = both.agg(*[value.alias(name) for name, value in values.items()])
    compared = compared.filter(F.col("trips").isNotNull())
    return compared.select("month", *_with_change(DAILY_METRICS)).orderBy("month")


def _with_change(metrics: Sequence[str]) -> list[Column]:
    columns = []
    for m in metrics:
        change = percent_change(F.col(m), F.col(f"{m}_prev"))
        columns += [F.col(m), F.col(f"{m}_prev"), change.alias(f"{m}_pct")]
    return columns
