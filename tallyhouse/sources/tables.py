"""Reading tables: by name or path, by parameterised SQL, bounded samples, clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import month_start
from tallyhouse.functions.numbers import column_type, mean_sql, sum_sql
from tallyhouse.operators.frames import half_open

SAMPLE_ROWS = 5000
TASKS_PER_CORE = 2


def load(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """The catalog table ``name`` if it exists, else the Parquet data at ``path``.

    The choice is made by looking, never by catching a failed read; with neither
    there is an error and no stand-in data. The result is lazy, so filters and
    column choices made later reach the scan.
    """
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if path is None:
        raise LookupError(f"no table {name!r} in the catalog and no path given")
    return spark.read.parquet(path)


def store_by_month(df: DataFrame, name: str, path: str, date_column: str, month_column: str = "month") -> None:
    """Stores rows as the catalog table ``name``, one partition for each month of a date column.

    The files lie at ``path``; a month's rows are written by the tasks that hold them, a hot
    month by many. Rows without a date are a partition of their own.
    """
    if df.sparkSession.catalog.tableExists(name):
        raise ValueError(f"there is a table {name!r}")
    by_month = df.withColumn(month_column, month_start(F.col(date_column)))
    by_month.write.partitionBy(month_column).option("path", path).format("parquet").saveAsTable(name)


def load_months(
    spark: SparkSession, name: str, start: date, end: date, date_column: str, month_column: str = "month"
) -> DataFrame:
    """Rows of ``[start, end)`` of a table that ``store_by_month`` made, without the month column.

    Only the partitions of those months are listed and read; the rest is a range filter.
    """
    month = F.col(month_column)
    rows = load(spark, name).filter((month >= F.lit(start.replace(day=1))) & (month < F.lit(end)))
    return half_open(rows, date_column, start, end).drop(month_column)


def query(
    spark: SparkSession, text: str, args: Mapping[str, object] | None = None, **tables: DataFrame
) -> DataFrame:
    """Result of an SQL text; ``:name`` marks a typed parameter, ``{name}`` a DataFrame.

    Values are bound, never spliced into the text.
    """
    for value in (args or {}).values():
        if not isinstance(value, (bool, int, float, str, date, datetime, type(None))):
            raise TypeError(f"unsupported parameter {value!r}")
    return spark.sql(text, args=dict(args or {}), **tables)


def daily_sql(spark: SparkSession, trips: DataFrame, start: date, end: date) -> DataFrame:
    """Daily table over ``[start, end)`` as SQL text with bound dates; NaN counts as missing."""
    text = f"""
        SELECT CAST(trip_date AS DATE) AS day, COUNT(*) AS trips,
               {sum_sql('fare_eur')} AS revenue, {sum_sql('distance_km')} AS km
        FROM {{trips}} WHERE trip_date >= :start AND trip_date < :end
        GROUP BY 1 ORDER BY day"""
    return query(spark, text, {"start": start, "end": end}, trips=trips)


def month_sql(spark: SparkSession, trips: DataFrame, start: date, end: date) -> DataFrame:
    """Trips, mean fare and mean distance over ``[start, end)`` as SQL text; NaN is missing."""
    text = f"""
        SELECT COUNT(*) AS trips, {mean_sql('fare_eur')} AS avg_fare, {mean_sql('distance_km')} AS avg_km
        FROM {{trips}} WHERE trip_date >= :start AND trip_date < :end"""
    return query(spark, text, {"start": start, "end": end}, trips=trips)


def bounded_sample(
    df: DataFrame, n: int = SAMPLE_ROWS, order_by: Sequence[str] = ()
) -> DataFrame:
    """``n`` rows of a table.

    Without ``order_by`` any rows do, and Spark stops reading once it has them.
    With it the first ``n`` in that order are taken, the same ones every time; see
    ``first_rows``.
    """
    return first_rows(df, order_by, n) if order_by else df.limit(n)


def first_rows(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows by the given columns (NULL first), for use on a whole fact table.

    One scan without a shuffle of the keys. Every task keeps its own ``n`` best rows and hands
    them to the one that merges them. Input blocks are put together into a few tasks per
    core first, so what is merged grows with the cluster and not with the table.
    """
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(tasks).orderBy(*order_by).limit(n)


def normalise(
    df: DataFrame, dates: Sequence[str] = ("sale_date",), rename: Mapping[str, str] | None = None
) -> DataFrame:
    """Dates as DATE with unreadable ones NULL, and NaN as NULL in every number column.

    Absent columns are skipped. Columns that are already clean by type stay untouched,
    so filters on them still reach the scan.
    """
    if rename:
        df = df.withColumnsRenamed(dict(rename))
    fixed = {}
    for name in dates:
        kind = column_type(df, name)
        if kind == "string":
            fixed[name] = F.col(name).try_cast("timestamp_ntz").cast("date")
        elif kind is not None and kind.startswith("timestamp"):
            fixed[name] = F.col(name).cast("date")
        elif kind is not None and kind != "date":
            fixed[name] = F.lit(None).cast("date")
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            fixed[name] = F.when(~F.isnan(name), F.col(name))
    return df.withColumns(fixed) if fixed else df
