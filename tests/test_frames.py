from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import frames


@pytest.fixture(scope="module")
def sales(rows):
    return rows(
        "store int, sale_date date, weekly_sales double",
        (1, date(2010, 1, 1), 1.0),
        (2, date(2010, 1, 31), 2.0),
        (1, date(2010, 2, 1), 3.0),
        (None, date(2010, 1, 15), 4.0),
        (3, None, 5.0),
    )


def _sales(frame):
    return sorted(r.weekly_sales for r in frame.collect())


def test_present_columns_keep_the_wanted_order(sales):
    assert frames.present_columns(sales, ["weekly_sales", "x", "store"]).columns == [
        "weekly_sales", "store",
    ]


def test_chosen_metrics(rows):
    daily = rows("day date, trips bigint, revenue double, km double", (date(2010, 1, 1), 1, 2.0, 3.0))
    assert frames.chosen_metrics(daily, ["km", "trips"]).columns == ["day", "km", "trips"]
    for wrong in ([], ["tips"]):
        with pytest.raises(ValueError):
            frames.chosen_metrics(daily, wrong)


def test_mapped_names_and_null_for_the_rest(rows):
    frame = rows("x double", (0.0,), (1.0,), (2.0,), (None,))
    named = frame.select(frames.mapped(F.col("x"), {0.0: "no", 1.0: "yes"}).alias("n"))
    assert [r.n for r in named.collect()] == ["no", "yes", None, None]


def test_date_range_includes_both_days_and_drops_missing(sales):
    found = frames.date_range(sales, date(2010, 1, 1), date(2010, 1, 31))
    assert _sales(found) == [1.0, 2.0, 4.0]


def test_date_range_on_timestamps_and_text(rows):
    frame = rows("s string", ("2010-01-31 23:59:00",), ("2010-02-01",), ("soon",), (None,))
    stamps = frame.withColumn("t", F.col("s").try_cast("timestamp_ntz"))
    for column in ("s", "t"):
        found = frames.date_range(stamps, date(2010, 1, 1), date(2010, 1, 31), column)
        assert [r.s for r in found.collect()] == ["2010-01-31 23:59:00"]


def test_filters_with_and_without_stores(sales):
    year = (date(2010, 1, 1), date(2010, 12, 31))
    assert _sales(frames.apply_filters(sales, *year)) == [1.0, 2.0, 3.0, 4.0]
    assert _sales(frames.apply_filters(sales, *year, stores=[1])) == [1.0, 3.0]
    assert _sales(frames.apply_filters(sales, *year, stores=[9])) == []


def test_in_domain_coerces_first(rows):
    frame = rows("f string", ("0",), ("1",), ("2",), ("-1",), ("1.0",), ("yes",), (None,))
    assert sorted(r.f for r in frames.in_domain(frame, "f", [0, 1]).collect()) == [0.0, 1.0, 1.0]


def test_drop_missing(rows):
    frame = rows("a double, b string", (1.0, "x"), (float("nan"), "x"), (None, "x"), (2.0, None))
    assert frames.drop_missing(frame).count() == 1
    assert frames.drop_missing(frame, ["a"]).count() == 2


def test_equal_pair_and_month(rows):
    frame = rows("a int, b int, day date", (1, 2, date(2010, 3, 1)), (1, 3, date(2011, 3, 31)))
    assert frames.equal_pair(frame, ("a", 1), ("b", 3)).count() == 1
    assert frames.in_month(frame, 3).count() == 2 and frames.in_month(frame, 4).count() == 0


def test_stacked_sets_match_by_name(rows):
    valid = rows("a int, b string", (1, "x"))
    quarantine = rows("b string, c int", ("y", 2))
    out = {r.set: r for r in frames.stack_sets(valid, quarantine).collect()}
    assert (out["Valid"].a, out["Valid"].b, out["Valid"].c) == (1, "x", None)
    assert (out["Quarantine"].a, out["Quarantine"].b, out["Quarantine"].c) == (None, "y", 2)
