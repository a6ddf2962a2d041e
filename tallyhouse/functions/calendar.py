"""Months, month names and calendar spines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names as they are shown to the user.
MONTH_NAMES = [
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
]


def year_bounds(year: int) -> tuple[date, date]:
    """First day of a year and of the next one."""
    return date(year, 1, 1), date(year + 1, 1, 1)


def month_bounds(year: int, month: int) -> tuple[date, date]:
    """First day of a month and of the next one."""
    return date(year, month, 1), shift_month(date(year, month, 1), 1)


def shift_month(day: date, months: int) -> date:
    """First day of the month ``months`` away from the month of ``day``."""
    index = day.year * 12 + day.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


def month_start(day: Column, months: int = 0) -> Column:
    """First day of the month ``months`` away, as DATE."""
    first = F.trunc(day, "MM")
    return F.add_months(first, months) if months else first


def month_name(day: Column) -> Column:
    """Portuguese name of the month of ``day``."""
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return F.element_at(names, F.month(day))


def calendar_spine(
    spark: SparkSession, start: date, end: date, step_days: int = 1, name: str = "day"
) -> DataFrame:
    """Every ``step_days``-th day in ``[start, end)``, one row each.

    Built by Spark from a range, so a long spine is spread over tasks.
    """
    count = max(0, -(-(end - start).days // step_days))
    days = spark.range(count).select(
        F.date_add(F.lit(start), (F.col("id") * step_days).cast("int")).alias(name)
    )
    return days
