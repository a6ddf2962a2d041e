"""Sales labels and metric zones from exact quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import exact_mean, identifier, known, number
from tallyhouse.functions.quantiles import quantiles
from tallyhouse.operators.frames import SETS

# Names and cut points of labels and zones.
LABELS = ("Low", "Medium", "High")
LABEL_CUTS = (0.33, 0.66)
ZONES = ("Baixa", "Média", "Alta")
TERCILE_EDGES = (0.0, 1 / 3, 2 / 3, 1.0)
FALLBACK_CUTS = (0.33, 0.66)
MIN_ZONE_ROWS = 5


def sales_label(
    df: DataFrame, value: str = "weekly_sales", column: str = "sales_label",
    accuracy: int | None = None,
) -> DataFrame:
    """Adds High / Medium / Low by the 0.33 and 0.66 quantiles of the whole column.

    A value on a cut gets the higher label; a missing value is Low. The two cuts come
    from a scalar subquery, so the table itself is neither shuffled nor joined.
    """
    low, medium, high = LABELS
    amount = known(number(df, value))
    cuts = quantiles(df, amount, LABEL_CUTS, accuracy=accuracy).select("q").scalar()
    label = (
        F.when(F.col("_amount") >= F.col("_cuts")[1], high)
        .when(F.col("_amount") >= F.col("_cuts")[0], medium)
        .otherwise(low)
    )
    return (
        df.withColumns({"_amount": amount, "_cuts": cuts})
        .withColumn(column, label)
        .drop("_amount", "_cuts")
    )


def metric_zones(
    sales: DataFrame, metric: str, value: str = "weekly_sales", accuracy: int | None = None
) -> DataFrame:
    """Rows ``(set, metric, value, zone)`` with each set's metric cut into three zones.

    Rows missing either number are dropped, and a set with fewer than five left gets no
    zones (NULL). The cuts are the terciles, or the 0.33 and 0.66 quantiles where two of the
    tercile edges coincide; a value on a cut belongs to the lower zone.
    """
    amount = number(sales, value)
    x = F.when(known(amount).isNotNull(), number(sales, metric))
    found = quantiles(sales, x, TERCILE_EDGES + FALLBACK_CUTS, "set", SETS, accuracy)
    found = found.filter(F.col("n") >= MIN_ZONE_ROWS)
    edge = [F.col("q")[i] for i in range(len(TERCILE_EDGES) + len(FALLBACK_CUTS))]
    apart = (edge[0] < edge[1]) & (edge[1] < edge[2]) & (edge[2] < edge[3])
    per_set = found.select(
        "set",
        F.struct(
            F.when(apart, edge[1]).otherwise(edge[4]).alias("low"),
            F.when(apart, edge[2]).otherwise(edge[5]).alias("high"),
        ).alias("cuts"),
    )
    # At most one entry per name in SETS, read by every task as a constant.
    cuts_by_set = per_set.agg(F.map_from_entries(F.collect_list(F.struct("set", "cuts")))).scalar()
    cuts = F.col("cuts")
    low, middle, high = ZONES
    zone = (
        F.when(F.col(metric) <= cuts["low"], low)
        .when(F.col(metric) <= cuts["high"], middle)
        .when(cuts.isNotNull(), high)
    )
    rows = sales.select("set", number(sales, metric).alias(metric), amount.alias(value)).dropna()
    return (
        rows.withColumn("cuts", F.element_at(cuts_by_set, F.col("set")))
        .withColumn("zone", zone)
        .drop("cuts")
    )


def zone_means(zones: DataFrame, value: str = "weekly_sales") -> DataFrame:
    """Mean sales per zone and set."""
    return zones.groupBy("set", "zone").agg(exact_mean(identifier(value)).alias("avg_sales"))


def complete_grid(means: DataFrame) -> DataFrame:
    """Every zone of every set, in order, with NULL where there is no mean.

    ``zone_rank`` and ``set_rank`` carry the display order.
    """
    cells = [
        F.struct(
            F.lit(zone).alias("zone"),
            F.lit(zone_rank).alias("zone_rank"),
            F.lit(name).alias("set"),
            F.lit(set_rank).alias("set_rank"),
            F.avg(
                F.when((F.col("zone") == zone) & (F.col("set") == name), F.col("avg_sales"))
            ).alias("avg_sales"),
        )
        for zone_rank, zone in enumerate(ZONES)
        for set_rank, name in enumerate(SETS)
    ]
    return means.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def zone_effect(sales: DataFrame, metric: str, accuracy: int | None = None) -> DataFrame:
    """Mean sales in the low, middle and high zone of a metric, per set."""
    return complete_grid(zone_means(metric_zones(sales, metric, accuracy=accuracy)))
