"""Projections, filters and the tagged union that the other operators build on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import column_type, number

VALID = "Valid"
QUARANTINE = "Quarantine"
SETS = (VALID, QUARANTINE)
DAILY_METRICS = ("trips", "revenue", "km")
SALES_METRICS = ("temperature", "fuel_price", "unemployment", "cpi")


# --- projections -------------------------------------------------------------------


def present_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[name for name in wanted if column_type(df, name) is not None])


def chosen_metrics(daily: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``day`` and the chosen metrics of a daily table; an empty choice is an error."""
    if not metrics:
        raise ValueError("choose at least one metric")
    unknown = set(metrics) - set(DAILY_METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    return daily.select("day", *metrics)


def pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Two columns, as for a scatter plot."""
    return df.select(x, y)


def tagged(df: DataFrame, label: str, column: str = "set") -> DataFrame:
    """Adds a constant label column."""
    return df.withColumn(column, F.lit(label))


def mapped(column: Column, names: Mapping[object, str]) -> Column:
    """Fixed values replaced by names; anything else becomes NULL."""
    cases = reduce(
        lambda chain, item: chain.when(column == F.lit(item[0]), F.lit(item[1])),
        names.items(),
        F,
    )
    return cases


def day_of(column: Column) -> Column:
    """Timestamp to day."""
    return column.cast("date")


# --- filters -----------------------------------------------------------------------


def equal_pair(df: DataFrame, first: tuple[str, object], second: tuple[str, object]) -> DataFrame:
    """Rows where both columns equal their value."""
    return df.filter((F.col(first[0]) == first[1]) & (F.col(second[0]) == second[1]))


def half_open(df: DataFrame, column: str, start: date, end: date) -> DataFrame:
    """``start <= column < end`` on a DATE or timestamp column.

    The column is left bare, so the range reaches the scan's statistics and partitions.
    """
    return df.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def in_month(df: DataFrame, month: int, column: str = "day") -> DataFrame:
    """Rows of one calendar month of any year. On facts prefer ``half_open``."""
    return df.filter(F.month(column) == month)


def date_range(df: DataFrame, start: date, end: date, column: str = "sale_date") -> DataFrame:
    """``start <= day <= end`` with both days included; rows without a date are dropped."""
    if column_type(df, column) == "string":
        day = F.col(column).try_cast("timestamp_ntz").cast("date")
        return df.filter(day.between(F.lit(start), F.lit(end)))
    return half_open(df, column, start, end + timedelta(days=1))


def in_list(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """Rows whose value is listed; an empty list keeps every row."""
    return df.filter(F.col(column).isin(*values)) if values else df


def apply_filters(
    df: DataFrame,
    start: date,
    end: date,
    stores: Sequence[int] = (),
    date_column: str = "sale_date",
    store_column: str = "store",
) -> DataFrame:
    """Inclusive date range and optional store list, applied alike to every set."""
    return in_list(date_range(df, start, end, date_column), store_column, stores)


def in_domain(df: DataFrame, column: str, allowed: Sequence[float]) -> DataFrame:
    """Column coerced to a number; only rows with an allowed value are kept."""
    return df.withColumn(column, number(df, column)).filter(
        F.col(column).isin(*[float(v) for v in allowed])
    )


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drops rows with a NULL or NaN in any of the columns (default: all)."""
    return df.dropna(how="any", subset=list(subset) if subset is not None else None)


# --- union -------------------------------------------------------------------------


def stack_sets(valid: DataFrame, quarantine: DataFrame, column: str = "set") -> DataFrame:
    """Both tables under one another, by column name, with a label of their origin.

    A column only one of them has is NULL for the other.
    """
    return tagged(valid, VALID, column).unionByName(
        tagged(quarantine, QUARANTINE, column), allowMissingColumns=True
    )
