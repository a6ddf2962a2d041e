"""Exact interpolated quantiles without gathering the column anywhere.

``percentile`` keeps every distinct value of a group in one task's memory. On a
price column of a large table that is the whole column. Here the wanted ranks are
found by narrowing instead:

1. Count the rows of a fixed logarithmic grid (about 11,000 cells for any DOUBLE),
   keep each cell's smallest and largest value, and add the counts up in grid order.
   That names the one or two cells holding each wanted rank.
2. Cut each of those cells into ``PARTS`` equally wide parts of its own range of values,
   count again, and so on, until every cell that holds a wanted rank has ``LAST_ROWS`` rows
   at most, or a single value. A pass makes cells at least ``PARTS`` times narrower and always
   parts the smallest value from the largest, so a handful of passes does for any DOUBLEs.
3. Count the distinct values of the cells that remain and read the values off.

Each pass scans one column and sums counts on the map side, so a value that fills a
third of the table is one number per task. The driver keeps the cells of the wanted ranks,
at most two per quantile and group, and sends them to the next pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

PARTS = 4096
LAST_ROWS = 250_000
_STEPS_PER_E = 8
_LARGEST_LOG = 800.0  # above the logarithm of any finite DOUBLE: infinity has its own cell
_CELL = "g int, c bigint, lo double, hi double, n bigint, total bigint, before bigint"


def quantiles(
    df: DataFrame,
    value: Column,
    probabilities: Sequence[float],
    by: str | None = None,
    groups: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """One row per group: ``by``, ``n`` (values counted) and ``q`` (array of quantiles).

    ``value`` is a DOUBLE expression; NULL and NaN are skipped. With ``by``, the closed
    list ``groups`` names the groups to return; it bounds what is broadcast. A group
    without values has no row. ``accuracy`` switches to ``percentile_approx``: one pass,
    but elements of the column rather than interpolated values.

    The narrowing passes run when this is called; the result is a plan over the last cells.
    """
    if by is not None and not groups:
        raise ValueError("name the groups: they bound what is broadcast")
    # Rows of other groups share the number 0. They are told apart only at the end: a
    # filter here would make every scan evaluate ``by`` a second time.
    names = F.array(*[F.lit(name) for name in groups])
    group = F.lit(1) if by is None else F.array_position(names, F.col(by)).cast("int")
    values = df.select(group.alias("g"), value.alias("x")).filter(
        F.col("x").isNotNull() & ~F.isnan("x")
    )
    if accuracy is not None:
        grouped = values.groupBy("g")
        total, found = F.count("x"), F.percentile_approx("x", list(probabilities), accuracy)
    else:
        grouped = _ranked_values(values, probabilities).groupBy("g")
        total, found = F.max("total"), F.array(*_interpolated(len(probabilities)))
    result = grouped.agg(F.when(F.col("g") > 0, total).alias("n"), found.alias("q"))
    result = result.filter(F.col("n").isNotNull())
    if by is None:
        return result.drop("g")
    return result.select(F.element_at(names, F.col("g")).alias(by), "n", "q")


def _ranked_values(values: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Rows ``(g, total, i, side, frac, x)``: both neighbours of every quantile."""
    coarse = _gridded(values)
    cells = narrowed(coarse, probabilities)
    last = _inside(coarse, cells).groupBy("g", "c", "lo", "total", "before", "x")
    last = _running(last.agg(F.count("*").alias("n")), ["g", "c", "lo"], "x")
    return (
        last.withColumn("t", F.explode(_targets(probabilities)))
        .filter(_holds(F.col("t.rank")))
        .select("g", "total", "t.i", "t.side", "t.frac", "x")
    )


def _gridded(values: DataFrame) -> DataFrame:
    """The values with ``c``, their cell of the logarithmic grid."""
    x = F.col("x")
    size = F.least(F.log1p(F.abs(x)), F.lit(_LARGEST_LOG))
    return values.withColumn("c", (F.signum(x) * F.floor(size * _STEPS_PER_E)).cast("bigint"))


def narrowed(coarse: DataFrame, probabilities: Sequence[float]) -> list[Row]:
    """The cells that hold the wanted ranks, as rows of ``_CELL``; none holds many values."""
    hit = F.exists(
        _array(probabilities),
        lambda p: _holds(F.floor(_position(p))) | _holds(F.ceil(_position(p))),
    )
    kept = ["g", "c", "lo", "hi", "n", "total", "before"]
    grid = coarse.groupBy("g", "c").agg(*_cell()).filter(F.col("g") > 0)
    whole = Window.partitionBy("g").orderBy("c").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    grid = grid.withColumn("total", F.sum("n").over(whole))
    grid = _running(grid.withColumn("before", F.lit(0).cast("bigint")), ["g"], "c")
    cells = grid.filter(hit).select(*kept).collect()
    x, lo, hi = (F.col(c) for c in ("x", "from", "to"))
    step = F.floor((x - lo) / (hi - lo) * PARTS)  # rises with x; the largest value has its own
    small = []
    while cells:
        small += [cell for cell in cells if cell.n <= LAST_ROWS or cell.lo == cell.hi]
        wide = [cell for cell in cells if cell.n > LAST_ROWS and cell.lo < cell.hi]
        if not wide:
            break
        rows = _inside(coarse, wide).withColumnsRenamed({"lo": "from", "hi": "to"}).withColumn("step", step)
        parts = rows.groupBy("g", "c", "from", "total", "before", "step").agg(*_cell())
        cells = _running(parts, ["g", "c", "from"], "step").filter(hit).select(*kept).collect()
    return small


def _inside(coarse: DataFrame, cells: Sequence[Row]) -> DataFrame:
    """The values lying in the given cells, each with its cell. Cells do not overlap."""
    x = F.col("x")
    known = coarse.sparkSession.createDataFrame(cells, _CELL).drop("n")
    if cells:  # the range reaches the scan where x is a bare column
        coarse = coarse.filter((x >= min(c.lo for c in cells)) & (x <= max(c.hi for c in cells)))
    return coarse.join(F.broadcast(known), ["g", "c"]).filter((x >= F.col("lo")) & (x <= F.col("hi")))


def _cell() -> list[Column]:
    return [F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]


def _running(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds to ``before`` the rows of the cells that sort earlier within ``keys``."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return counts.withColumn("before", F.col("before") + rows)


def _array(probabilities: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(p)) for p in probabilities])


def _position(p: Column) -> Column:
    """Place of a quantile among the ranks, counted from 0."""
    return p * (F.col("total") - 1).cast("double")


def _targets(probabilities: Sequence[float]) -> Column:
    """The wanted ranks: two neighbours per quantile."""

    def neighbours(p: Column, i: Column) -> Column:
        position = _position(p)
        frac = (position - F.floor(position)).alias("frac")
        sides = [
            F.struct(i.alias("i"), F.lit(side).alias("side"), rank.alias("rank"), frac)
            for side, rank in enumerate((F.floor(position), F.ceil(position)))
        ]
        return F.array(*sides)

    return F.flatten(F.transform(_array(probabilities), neighbours))


def _holds(rank: Column) -> Column:
    return (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))


def _interpolated(count: int) -> list[Column]:
    """Lower value plus the fraction of the gap; equal neighbours give that very value."""
    picks = []
    for i in range(count):
        low, high = (
            F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("x")))
            for side in (0, 1)
        )
        frac = F.max(F.when(F.col("i") == i, F.col("frac")))
        picks.append(low + F.when(high > low, (high - low) * frac).otherwise(0.0))
    return picks
