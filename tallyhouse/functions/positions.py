"""Places of rows in an order, by a distributed prefix sum.

``row_number`` over a window without a partition, or over one hot group, sorts all of its
rows in one task. Here rows are dealt by range, so that every task holds a consecutive part
of the order and knows its rows' places within it; the parts' totals, a few numbers per
task, are added up, and each row adds what lies before its part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.lineage import cut

_ROW_BITS = 33  # of monotonically_increasing_id: partition number above, row number below


def _equal(left: DataFrame, right: DataFrame, names: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, [left[a].eqNullSafe(right[b]) for a, b in names])


def dealt_in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows sorted by ``order`` (NULL first) over range partitions, with ``_part`` and ``_at``.

    ``_part`` numbers the partitions in order and ``_at`` the rows within one, from 0. Both
    are fixed: the sorted rows are read back from the checkpoint folder.
    """
    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    number = F.monotonically_increasing_id()
    return ordered.withColumn("_row", number).select(
        *df.columns,
        F.shiftright("_row", _ROW_BITS).alias("_part"),
        F.col("_row").bitwiseAND(2**_ROW_BITS - 1).alias("_at"),
    )


def numbered(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), place: str = "place", total: str | None = None
) -> DataFrame:
    """Adds the place (from 0) of every row in ``order``, within the groups ``by``.

    NULL sorts first and is a group of its own. Rows that tie in ``order`` get places next
    to one another. ``total`` names a further column for the rows of the group. A group of
    any size is numbered by all tasks that hold a part of it; what a task adds up is one
    total per part of a group.
    """
    rows = dealt_in_order(df, [*by, *order])
    parts = rows.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    groups = [F.col(b) for b in by] or [F.lit(0)]
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("_part").alias("_of"), *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)],
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"),
        F.sum("_n").over(whole).alias("_total"),
    )
    names = [("_part", "_of"), *[(b, f"_by{i}") for i, b in enumerate(by)]]
    joined = rows.join(offsets, _equal(rows, offsets, names))
    added = [(F.col("_offset") + F.col("_at")).alias(place)]
    return joined.select(*df.columns, *added, *([F.col("_total").alias(total)] if total else []))
