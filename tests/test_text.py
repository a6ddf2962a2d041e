import random

from pyspark.sql import functions as F

from tallyhouse.functions import text


def _texts(rows, function, values):
    frame = rows("i int, x double", *enumerate(values))
    return [r.t for r in frame.orderBy("i").select(function(F.col("x")).alias("t")).collect()]


def test_texts(rows):
    assert _texts(rows, text.money_text, [1234.5, 0.0, 1234567.891, None]) == [
        "€ 1 234,50", "€ 0,00", "€ 1 234 567,89", None,
    ]
    assert _texts(rows, text.km_text, [1234.56, 0.04, None]) == ["1 234,6 km", "0,0 km", None]
    assert _texts(rows, text.whole_text, [1234567.9, 999.0]) == ["1 234 567", "999"]
    assert _texts(rows, text.dotted_text, [1234567.0, 12.0]) == ["1.234.567", "12"]
    assert _texts(rows, text.percent_text, [12.34, 100.0]) == ["12.3%", "100.0%"]
    assert _texts(rows, text.change_text, [1.23, -1.23, 0.0, 12345.6, None]) == [
        "+1.2%", "-1.2%", "+0.0%", "+12345.6%", "—",
    ]
    assert _texts(rows, text.billions_text, [1234567890.0, 0.0]) == ["$1.23B", "$0.00B"]


def test_rounding_agrees_with_python_also_on_ties(rows):
    rng = random.Random(5)
    values = [0.125, 0.375, 2.5, 0.25, 0.35, 0.05, 1.005, -0.25]
    values += [rng.uniform(-1e7, 1e7) for _ in range(300)] + [i / 8 for i in range(200)]
    assert _texts(rows, text.money_text, values) == [
        f"€ {v:,.2f}".translate(str.maketrans(",.", " ,")) for v in values
    ]
    assert _texts(rows, text.percent_text, values) == [f"{v:.1f}%" for v in values]
