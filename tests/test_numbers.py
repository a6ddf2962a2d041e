import math
import random
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from tallyhouse.functions.numbers import (
    exact_mean,
    exact_sum,
    identifier,
    literal,
    number,
    percent_change,
    percent_of,
)


def _sum(frame, column="x"):
    return frame.agg(exact_sum(column).alias("s")).head().s


def test_sum_is_the_correctly_rounded_decimal_sum_in_any_order(spark):
    rng = random.Random(1)
    values = [round(rng.uniform(-1e6, 1e6), rng.randint(0, 6)) for _ in range(5000)]
    expected = float(sum(Decimal(str(v)) for v in values))
    for order in (values, sorted(values), sorted(values, key=abs)):
        frame = spark.createDataFrame([(v,) for v in order], "x double").repartition(7)
        assert _sum(frame) == expected


def test_sum_skips_missing_and_is_zero_for_nothing(rows):
    assert _sum(rows("x double", (1.5,), (None,), (float("nan"),), (2.25,))) == 3.75
    assert _sum(rows("x double", (None,))) == 0.0
    assert _sum(rows("x double")) == 0.0


def test_values_too_large_to_be_exact_still_count(rows):
    assert _sum(rows("x double", (1e300,), (1.0,), (2e300,))) == 3e300
    assert _sum(rows("x double", (2.0**60,), (0.5,))) == 2.0**60 + 0.5
    assert _sum(rows("x double", (math.inf,), (1.0,))) == math.inf
    assert _sum(rows("x double", (-1e18,), (1e18,), (0.25,))) == 0.25


def test_mean_counts_only_known_values(rows):
    frame = rows("x double", (1.0,), (None,), (float("nan"),), (2.0,))
    assert frame.agg(exact_mean("x").alias("m")).head().m == 1.5
    assert rows("x double", (None,)).agg(exact_mean("x").alias("m")).head().m is None


def test_number_reads_text_and_drops_what_is_none(rows):
    frame = rows("t string, i int, d decimal(10,2)", ("1.5", 3, Decimal("2.50")), ("abc", None, None))
    out = frame.select(*[number(frame, c).alias(c) for c in frame.columns]).collect()
    assert [tuple(r) for r in out] == [(1.5, 3.0, 2.5), (None, None, None)]


def test_percentages(rows):
    frame = rows("a double, b double", (3.0, 2.0), (3.0, 0.0), (3.0, None), (0.0, 4.0))
    out = frame.select(
        percent_change(F.col("a"), F.col("b")).alias("c"), percent_of(F.col("a"), F.col("b")).alias("p")
    ).collect()
    assert [r.c for r in out] == [50.0, None, None, -100.0]
    assert [r.p for r in out] == [150.0, 0.0, 0.0, 0.0]


def test_sums_drop_nothing_in_any_partitioning(spark):
    for value, n in ((1e-7, 1_000_000), (1.23456789, 1000), (9e12, 3_000_000), (0.4, 10), (-3e-9, 1000), (9.3e12, 100)):
        frame = spark.range(n).select(F.lit(value).alias("x"))
        sums = {_sum(frame.repartition(k)) for k in (1, 7)}
        assert len(sums) == 1 and math.isclose(sums.pop(), value * n, rel_tol=1e-12)
        mean = frame.agg(exact_mean("x").alias("m")).head().m
        assert math.isclose(mean, value, rel_tol=1e-12)


def test_text_that_only_a_lax_cast_reads_is_missing(rows):
    frame = rows("t string", *[(t,) for t in ("5d", "1f", "0x1", "1e3", " 7 ", "-.5", "+2.", "1_0", "Infinity", "")])
    assert [r.v for r in frame.select(number(frame, "t").alias("v")).collect()] == [
        None, None, None, 1000.0, 7.0, -0.5, 2.0, None, math.inf, None
    ]


def test_names_and_texts_are_quoted(rows):
    frame = rows("`a ``b` double, s string", (2.5, "it's \\ fine"))
    assert frame.agg(exact_sum(identifier("a `b")).alias("x")).head().x == 2.5
    assert frame.filter(F.expr(f"s = {literal(chr(105) + 't' + chr(39) + 's ' + chr(92) + ' fine')}")).count() == 1


def _counted(value):
    """What a double counts as: its millionths if it is as good as those, else itself."""
    near = Fraction(round(Fraction(value) * 10**6), 10**6)
    return near if abs(value - float(near)) <= min(abs(value) * 4.5e-16, 2.0**-32) else Fraction(value)


def test_sums_are_exact_for_decimals_and_for_binary_numbers(spark):
    rng = random.Random(12)
    kinds = {
        "cents": [round(rng.uniform(-1e6, 1e6), 2) for _ in range(3000)],
        "millionths": [round(rng.uniform(0, 9e9), 6) for _ in range(3000)],
        "floats": [rng.uniform(-1, 1) * 2.0 ** rng.randrange(-10, 30) for _ in range(3000)],
        "sums of decimals": [2.0 + rng.randrange(100) / 50 for _ in range(3000)],
        "cancelling": [v for _ in range(500) for x in [rng.uniform(0, 1e9)] for v in (x, -x)] + [1e-9],
        "one unit in the last place": [1000000000.00000012] * 2000,
    }
    for name, values in kinds.items():
        frame = spark.createDataFrame([(v,) for v in values], "x double")
        found = {_sum(frame.repartition(k)) for k in (1, 7)}
        assert len(found) == 1, name
        expected = sum(map(_counted, values))
        parts = [f for f in map(_counted, values) if f.denominator & (f.denominator - 1) == 0 and 10**6 % f.denominator]
        if not parts:  # nothing but decimals: rounded once
            assert found == {float(expected)}, name
        assert abs(Fraction(found.pop()) - expected) <= Fraction(math.ulp(float(expected))), name
        assert name in ("cents", "millionths", "sums of decimals") or abs(float(expected) - math.fsum(values)) <= 2 * math.ulp(math.fsum(values))


def test_a_mean_of_equal_values_is_that_value(spark):
    for value in (1000000000.00000012, 0.1, 123.456789, 2.0**52 + 1, 9e9 + 0.25, 3e15, 1 / 3, 8e-7):
        frame = spark.range(100_000).select(F.lit(value).alias("x"))
        found = frame.agg(exact_mean("x").alias("m")).head().m
        assert abs(found - value) <= (0 if value != 1 / 3 else math.ulp(value))  # a sum is rounded before it is divided
