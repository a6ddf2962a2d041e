"""Sales monitoring over rows labelled ``set`` = Valid or Quarantine.

Every operator takes one labelled table (``quality.label_sets`` or
``frames.stack_sets``) and groups by ``set``, so both sets cost one scan.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import (
    exact_mean,
    exact_sum,
    known,
    literal,
    number,
    number_sql,
    percent_of,
)
from tallyhouse.operators.frames import (
    QUARANTINE,
    SALES_METRICS,
    VALID,
    in_domain,
    mapped,
)
from tallyhouse.operators.rollup import rolling_mean

# Names of the holiday flag, days shown where no row has a date.
HOLIDAY_NAMES = {0.0: "Sem feriado", 1.0: "Com feriado"}
DEFAULT_FIRST_DAY = date(2010, 1, 1)
DEFAULT_LAST_DAY = date(2010, 12, 31)

TOP_STORES = 12
TOP_OFFENDERS = 8


def set_shares(sales: DataFrame) -> DataFrame:
    """One row: rows in total and per set, and each set's share in percent."""
    return sales.agg(*_share_columns())


def sales_by_set(sales: DataFrame) -> DataFrame:
    """One row: sales sum of each set; unreadable values count as missing, no rows as 0."""
    return sales.agg(*_sales_columns(sales))


def set_kpis(sales: DataFrame) -> DataFrame:
    """``set_shares`` and ``sales_by_set`` side by side, from one scan."""
    return sales.agg(*_share_columns(), *_sales_columns(sales))


def _share_columns() -> list[Column]:
    valid, quarantined = (F.count_if(F.col("set") == name) for name in (VALID, QUARANTINE))
    total = valid + quarantined
    return [
        total.alias("total_rows"),
        valid.alias("valid_rows"),
        quarantined.alias("quarantine_rows"),
        percent_of(valid, total).alias("valid_pct"),
        percent_of(quarantined, total).alias("quarantine_pct"),
    ]


def _sales_columns(sales: DataFrame) -> list[Column]:
    amount = number_sql(sales, "weekly_sales")
    return [
        exact_sum(f"CASE WHEN `set` = {literal(name)} THEN {amount} END").alias(column)
        for name, column in ((VALID, "valid_sales"), (QUARANTINE, "quarantine_sales"))
    ]


def sales_trend(sales: DataFrame) -> DataFrame:
    """Sales sum per date and set, in date order; rows without a date are left out."""
    return (
        sales.filter(F.col("sale_date").isNotNull())
        .groupBy("sale_date", "set")
        .agg(exact_sum(number_sql(sales, "weekly_sales")).alias("weekly_sales"))
        .orderBy("sale_date", "set")
    )


def holiday_effect(sales: DataFrame) -> DataFrame:
    """Mean sales with and without holiday per set; flags other than 0 and 1 left out."""
    return (
        in_domain(sales, "holiday_flag", [0, 1])
        .groupBy("set", mapped(F.col("holiday_flag"), HOLIDAY_NAMES).alias("holiday"))
        .agg(exact_mean(number_sql(sales, "weekly_sales")).alias("avg_sales"))
        .select("holiday", "avg_sales", "set")
    )


def daily_profile(sales: DataFrame, metric: str) -> DataFrame:
    """Mean of a metric and mean sales per date and set."""
    if metric not in SALES_METRICS:
        raise ValueError(f"choose one of {SALES_METRICS}")
    return (
        sales.filter(F.col("sale_date").isNotNull())
        .groupBy("sale_date", "set")
        .agg(
            exact_mean(number_sql(sales, metric)).alias(metric),
            exact_mean(number_sql(sales, "weekly_sales")).alias("weekly_sales"),
        )
    )


def daily_profile_rolling(profile: DataFrame, metric: str, rows: int = 7) -> DataFrame:
    """Profile with mean sales smoothed over ``rows`` dates per set; the metric stays raw.

    Runs on the profile (one row per date and set), never on sales rows.
    """
    return rolling_mean(
        profile, ["weekly_sales"], rows, by=["set"], order="sale_date", keep=[metric]
    )


def rows_per_store(sales: DataFrame) -> DataFrame:
    """Rows per store; rows whose store is no number, or none that fits an INT, are left out.

    Decimals are cut off before counting, so 3 and 3.5 are one store.
    """
    store = known(number(sales, "store")).try_cast("int")
    rows = sales.select(store.alias("store")).filter(F.col("store").isNotNull())
    return rows.groupBy("store").agg(F.count("*").alias("n"))


def top_offenders(quarantine: DataFrame, n: int = TOP_OFFENDERS) -> DataFrame:
    """Stores with most quarantined rows; ties go to the lower store number."""
    return rows_per_store(quarantine).orderBy(F.desc("n"), "store").limit(n)


def top_stores(valid: DataFrame, n: int = TOP_STORES) -> DataFrame:
    """Stores with the highest sales sum; ties go to the lower store number."""
    return (
        valid.dropna(subset=["store"])
        .groupBy("store")
        .agg(exact_sum(number_sql(valid, "weekly_sales")).alias("weekly_sales"))
        .orderBy(F.desc("weekly_sales"), "store")
        .limit(n)
    )


def date_bounds(sales: DataFrame) -> DataFrame:
    """First and last date over both sets; fixed days where no row has a date."""
    return sales.agg(
        F.coalesce(F.min("sale_date"), F.lit(DEFAULT_FIRST_DAY)).alias("first_day"),
        F.coalesce(F.max("sale_date"), F.lit(DEFAULT_LAST_DAY)).alias("last_day"),
    )


def store_options(sales: DataFrame) -> DataFrame:
    """Distinct stores, ascending, without NULL."""
    return sales.select("store").dropna().distinct().orderBy("store")
