import numpy as np
import pytest

from tallyhouse.operators import zones

SCHEMA = "set string, temperature double, weekly_sales double"


def test_label_cuts_belong_to_the_higher_label(rows):
    values = [float(v) for v in range(101)]
    frame = rows("weekly_sales double", *[(v,) for v in values], (None,), (float("nan"),))
    out = zones.sales_label(frame).collect()
    labels = {r.weekly_sales: r.sales_label for r in out[:101]}
    q33, q66 = np.quantile(values, [0.33, 0.66])
    for v, label in labels.items():
        assert label == ("High" if v >= q66 else "Medium" if v >= q33 else "Low")
    assert [r.sales_label for r in out[101:]] == ["Low", "Low"]


def test_a_constant_column_is_all_high(rows):
    frame = rows("weekly_sales double", *[(0.1,)] * 9)
    assert {r.sales_label for r in zones.sales_label(frame).collect()} == {"High"}


def test_approximate_labels_differ_only_near_the_cuts(spark):
    frame = spark.range(3000).selectExpr("CAST(id AS DOUBLE) AS weekly_sales")
    exact = zones.sales_label(frame)
    rough = zones.sales_label(frame, column="rough", accuracy=1000)
    both = exact.join(rough, "weekly_sales").filter("sales_label <> rough")
    assert both.count() <= 12


def _zones(frame):
    out = zones.metric_zones(frame, "temperature").collect()
    return sorted((r.set, r.temperature, r.zone) for r in out)


def test_terciles_per_set_close_on_the_right(rows):
    valid = [("Valid", float(v), 1.0) for v in range(7)]
    quarantine = [("Quarantine", float(v), 1.0) for v in range(0, 70, 10)]
    names = ["Baixa"] * 3 + ["Média"] * 2 + ["Alta"] * 2
    assert [z for *_, z in _zones(rows(SCHEMA, *valid, *quarantine))] == names + names


def test_fallback_when_tercile_edges_coincide(rows):
    values = [0.0] * 6 + [1.0, 2.0, 3.0]  # smallest value and first tercile coincide
    frame = rows(SCHEMA, *[("Valid", v, 1.0) for v in values])
    q1, q2 = np.quantile(values, [0.33, 0.66])
    expected = ["Baixa" if v <= q1 else "Média" if v <= q2 else "Alta" for v in values]
    assert [z for *_, z in _zones(frame)] == expected


@pytest.mark.parametrize("count, zoned", [(4, 0), (5, 5)])
def test_a_set_needs_five_complete_rows(rows, count, zoned):
    data = [("Valid", float(v), 1.0) for v in range(count)]
    frame = rows(SCHEMA, *data, ("Valid", None, 1.0), ("Valid", 9.0, None), ("Valid", float("nan"), 1.0))
    out = _zones(frame)
    assert len(out) == count and sum(z is not None for *_, z in out) == zoned


def test_the_grid_always_has_six_cells(rows):
    frame = rows(SCHEMA, *[("Valid", float(v), v * 10.0) for v in range(6)], ("Quarantine", 1.0, 1.0))
    out = [tuple(r) for r in zones.zone_effect(frame, "temperature").collect()]
    assert [(z, s) for z, _, s, _, _ in out] == [
        (z, s) for z in ("Baixa", "Média", "Alta") for s in ("Valid", "Quarantine")
    ]
    assert [mean for *_, mean in out] == [5.0, None, 25.0, None, 45.0, None]
    assert len(zones.zone_effect(rows(SCHEMA), "temperature").collect()) == 6
