"""Number columns: coercion, order-independent sums and means, percent change.

Double addition depends on the order of the rows, so two runs of one query (or one
run with a lost executor) may differ in the last digits, and a decimal sum turns every value
into a BigDecimal. ``exact_sum`` adds whole millionths as two BIGINT parts instead, which
stays in codegen, and only what a value has beside its millionths as a decimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = "1E6D"  # units of a millionth
_UNITS_BELOW = "9007199254.740992D"  # 2^53 millionths: units are exact as doubles below
_LOW_BITS = 26
_REST_BITS = 82  # half a millionth in units of 2^-82 fits a BIGINT
_DECIMAL_BELOW = "1E22D"
_NOISE, _NOISE_BELOW = 4.5e-16, 2.0**-32  # two units in the last place, and a 4,000th of a millionth
# Text that is a number; a cast alone would also take 5d, 1f and the like.
_NUMERAL = r"^\\s*[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|inf(inity)?|nan)\\s*$"


def identifier(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column_type(df: DataFrame, name: str) -> str | None:
    """Type of column ``name`` in any spelling of its case, as Spark resolves it, or None."""
    return {column.lower(): kind for column, kind in df.dtypes}.get(name.lower())


def number_sql(df: DataFrame, name: str) -> str:
    """Column ``name`` as DOUBLE, in SQL text; text that is no number becomes NULL.

    A DOUBLE column is passed on bare. NaN may remain: the aggregates here, the
    quantiles and ``dropna`` all count it as missing, and ``known`` makes it NULL.
    """
    kind = column_type(df, name)
    if kind is None:
        raise KeyError(f"no column {name!r} among {df.columns}")
    if kind == "double":
        return identifier(name)
    if kind == "string":
        text = identifier(name)
        return f"CASE WHEN {text} RLIKE '(?i){_NUMERAL}' THEN try_cast({text} AS DOUBLE) END"
    return f"cast({identifier(name)} AS DOUBLE)"


def number(df: DataFrame, name: str) -> Column:
    """``number_sql`` as a column."""
    return F.expr(number_sql(df, name))


def known(column: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(column), column)


def exact_sum(value: str) -> Column:
    """Aggregate: sum of a DOUBLE expression (SQL text), 0 for no rows, NULL and NaN skipped.

    A value below 2^53 millionths is a whole number of millionths and a rest. The rest is
    the exact difference to the double nearest to those millionths, so it is 0 for every
    value that is a decimal of six places or fewer, which thus counts as that decimal (0.1
    as one tenth). So does a value computed from decimals that is off by two units in its last
    place at most (2 + 0.22), as long as that is less than 2^-32. All others count as the binary
    numbers they are. Millionths are
    added as BIGINT parts, rests as whole numbers of 2^-82, values from there up to 1e22 as
    decimals of six places: all three sums are exact in any order, for 2^36 rows of the
    largest values and more of smaller ones. Each is rounded once and then they are added. Only
    what lies outside (values of 1e22 and more, infinity, and digits below 2^-82 of
    values below 2^-30) is added as doubles.
    """
    return F.expr(sum_sql(value))


def exact_mean(value: str) -> Column:
    """Aggregate: mean of a DOUBLE expression (SQL text), NULL for no values."""
    return F.expr(mean_sql(value))


def mean_sql(value: str) -> str:
    """``exact_mean`` as SQL text."""
    counted = f"count(CASE WHEN NOT isnan({value}) THEN {value} END)"
    return f"try_divide({sum_sql(value)}, {counted})"


def sum_sql(value: str) -> str:
    """``exact_sum`` as SQL text."""
    value = f"({value})"
    size = f"abs({value})"
    units = f"CASE WHEN {size} < {_UNITS_BELOW} THEN CAST(rint({value} * {_STEP}) AS BIGINT) END"
    high, low = f"shiftright({units}, {_LOW_BITS})", f"(({units}) & {2**_LOW_BITS - 1})"
    high, low = (f"CAST(sum({part}) AS DECIMAL(20,0))" for part in (high, low))
    millionths = f"CAST(({high} * {2**_LOW_BITS}BD + {low}) * 0.000001BD AS DOUBLE)"
    power = f"{2.0**_REST_BITS!r}D"
    rest = f"({value} - CAST({units} AS DOUBLE) / {_STEP}) * {power}"
    noise = f"least({size} * {_NOISE * 2.0**_REST_BITS!r}D, {_NOISE_BELOW * 2.0**_REST_BITS!r}D)"
    whole = f"CASE WHEN abs({rest}) > {noise} THEN CAST(floor({rest}) AS DECIMAL(20,0)) END"
    rests = f"CAST(sum({whole}) AS DOUBLE) / {power}"
    decimal = f"CASE WHEN {size} >= {_UNITS_BELOW} AND {size} < {_DECIMAL_BELOW} THEN CAST({value} AS DECIMAL(28,6)) END"
    decimals = f"CAST(sum({decimal}) AS DOUBLE)"
    outside = f"CASE WHEN {size} < {_UNITS_BELOW} THEN ({rest} - floor({rest})) / {power} WHEN {size} >= {_DECIMAL_BELOW} AND NOT isnan({value}) THEN {value} END"
    return "(" + " + ".join(f"coalesce({s}, 0D)" for s in (millionths, rests, decimals, f"sum({outside})")) + ")"


def percent_change(current: Column, previous: Column) -> Column:
    """``(current - previous) / previous * 100``; NULL where previous is 0 or NULL."""
    return F.try_divide(current - previous, previous) * 100.0


def percent_of(part: Column, whole: Column) -> Column:
    """Share in percent, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole) * 100.0, F.lit(0.0))
