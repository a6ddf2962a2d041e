from datetime import date, timedelta

import pytest

from tallyhouse.operators import sales

SALES = (
    "set string, store int, sale_date date, weekly_sales double, holiday_flag int, "
    "temperature double"
)
D = date(2010, 1, 1)


@pytest.fixture(scope="module")
def frame(rows):
    return rows(
        SALES,
        ("Valid", 1, D, 10.0, 0, 5.0),
        ("Valid", 1, D, 20.0, 1, None),
        ("Valid", 2, D + timedelta(7), 30.0, 0, 7.0),
        ("Valid", None, D, 1000.0, 0, 9.0),
        ("Quarantine", 2, D, 5.0, 2, 80.0),
        ("Quarantine", 2, None, 7.0, 1, None),
        ("Quarantine", None, D, None, 1, 3.0),
    )


def test_shares_add_to_a_hundred(frame, rows):
    r = sales.set_shares(frame).head()
    assert (r.total_rows, r.valid_rows, r.quarantine_rows) == (7, 4, 3)
    assert r.valid_pct == 4 / 7 * 100 and abs(r.valid_pct + r.quarantine_pct - 100) < 1e-9
    assert tuple(sales.set_shares(rows(SALES)).head()) == (0, 0, 0, 0.0, 0.0)


def test_sales_by_set(frame, rows):
    assert tuple(sales.sales_by_set(frame).head()) == (1060.0, 12.0)
    assert tuple(sales.sales_by_set(rows(SALES)).head()) == (0.0, 0.0)
    both = sales.set_kpis(frame).head()
    assert (both.valid_rows, both.valid_sales) == (4, 1060.0)


def test_trend_leaves_out_missing_dates_and_sums_nothing_to_zero(frame, rows):
    out = [tuple(r) for r in sales.sales_trend(frame).collect()]
    assert out == [
        (D, "Quarantine", 5.0), (D, "Valid", 1030.0), (D + timedelta(7), "Valid", 30.0),
    ]
    only_null = rows(SALES, ("Valid", 1, D, None, 0, 0.0))
    assert sales.sales_trend(only_null).head().weekly_sales == 0.0


def test_holiday_effect_ignores_other_flags(frame):
    out = {(r.set, r.holiday): r.avg_sales for r in sales.holiday_effect(frame).collect()}
    assert out == {
        ("Valid", "Sem feriado"): 1040.0 / 3,
        ("Valid", "Com feriado"): 20.0,
        ("Quarantine", "Com feriado"): 7.0,
    }


def test_daily_profile(frame):
    out = {(r.set, r.sale_date): r for r in sales.daily_profile(frame, "temperature").collect()}
    assert set(out) == {("Valid", D), ("Valid", D + timedelta(7)), ("Quarantine", D)}
    assert out["Valid", D].temperature == 7.0 and out["Valid", D].weekly_sales == 1030.0 / 3
    assert out["Quarantine", D].weekly_sales == 5.0
    with pytest.raises(ValueError):
        sales.daily_profile(frame, "store")


def test_rolling_profile_smooths_sales_per_set_only(rows):
    values = [
        (name, 1, D + timedelta(7 * i), float(i), 0, float(i))
        for name, count in (("Valid", 9), ("Quarantine", 6)) for i in range(count)
    ]
    profile = sales.daily_profile(rows(SALES, *values), "temperature")
    out = sales.daily_profile_rolling(profile, "temperature").orderBy("sale_date").collect()
    assert [(r.set, r.temperature, r.weekly_sales) for r in out] == [
        ("Valid", 6.0, 3.0), ("Valid", 7.0, 4.0), ("Valid", 8.0, 5.0),
    ]


def test_top_stores_and_offenders_break_ties_by_store(rows):
    data = [("Valid", s, D, 5.0, 0, 0.0) for s in (9, 3, 7)] + [("Valid", 1, D, None, 0, 0.0)]
    frame = rows(SALES, *data)
    assert [tuple(r) for r in sales.top_stores(frame, 4).collect()] == [
        (3, 5.0), (7, 5.0), (9, 5.0), (1, 0.0),
    ]
    assert [tuple(r) for r in sales.top_offenders(frame, 2).collect()] == [(1, 1), (3, 1)]


def test_rows_per_store_coerces_text(rows):
    frame = rows("store string", ("3",), ("3.0",), ("x",), (None,), ("NaN",))
    assert [tuple(r) for r in sales.rows_per_store(frame).collect()] == [(3, 2)]


def test_bounds_and_options(frame, rows):
    assert tuple(sales.date_bounds(frame).head()) == (D, D + timedelta(7))
    assert tuple(sales.date_bounds(rows(SALES)).head()) == (date(2010, 1, 1), date(2010, 12, 31))
    assert [r.store for r in sales.store_options(frame).collect()] == [1, 2]
    loose = rows("store double", (2.0,), (float("nan"),), (None,), (1.0,))
    assert [r.store for r in sales.store_options(loose).collect()] == [1.0, 2.0]
