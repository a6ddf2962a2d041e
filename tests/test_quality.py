import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import quality, sales
from tallyhouse.plans import views

from tests.conftest import TESTDATA

SALES = (
    "id bigint, store int, sale_date date, weekly_sales double, holiday_flag int, "
    "temperature double, fuel_price double, cpi double, unemployment double, sales_label string"
)
CLEAN = dict(
    id=1, store=1, sale_date=date(2010, 2, 5), weekly_sales=1.0, holiday_flag=0, temperature=20.0,
    fuel_price=2.5, cpi=211.0, unemployment=8.0, sales_label="High",
)


def _row(**changes):
    return tuple({**CLEAN, **changes}.values())


def _names(text):
    return None if text is None else [i["name"] for i in json.loads(text)["items"]]


@pytest.mark.parametrize(
    "changes, errors, warnings",
    [
        ({}, None, None),
        ({"temperature": None}, [], ["Temperature_is_null"]),
        ({"temperature": float("nan")}, [], ["Temperature_is_null"]),
        ({"temperature": -10.0}, None, None),
        ({"temperature": 55.0}, None, None),
        ({"temperature": 55.01}, ["Temperature_isnt_in_range"], []),
        ({"temperature": -25.0}, ["Temperature_isnt_in_range"], []),
        ({"fuel_price": None}, ["Fuel_Price_is_null"], []),
        ({"holiday_flag": 2}, ["Holiday_Flag_other_value"], []),
        ({"holiday_flag": -1}, ["Holiday_Flag_other_value"], []),
        ({"holiday_flag": None}, [], ["Holiday_Flag_is_null"]),
        ({"sales_label": None}, ["Sales_Label_is_null"], []),
        ({"sales_label": "HIGH"}, ["Sales_Label_other_value"], []),
        ({"id": 6436}, ["id_isnt_in_range"], []),
        ({"id": None}, ["id_is_null"], []),
        ({"store": 46}, ["Store_isnt_in_range"], []),
        ({"store": 0, "cpi": None}, ["Store_isnt_in_range", "CPI_is_null"], []),
        ({"sale_date": None}, ["Date_is_null"], []),
        ({"weekly_sales": None}, ["Weekly_Sales_is_null"], []),
        ({"unemployment": None, "temperature": None}, ["Unemployment_is_null"],
         ["Temperature_is_null"]),
    ],
)
def test_rules(rows, changes, errors, warnings):
    r = quality.label_sets(rows(SALES, _row(**changes)), quality.sales_rules()).head()
    assert r.set == ("Valid" if errors is None else "Quarantine")
    assert _names(r["__errors"]) == errors and _names(r["__warnings"]) == warnings


def test_messages(rows):
    frame = rows(SALES, _row(temperature=80.0, holiday_flag=3, sales_label="Med", cpi=None))
    r = quality.label_sets(frame, quality.sales_rules()).head()
    assert {i["message"] for i in json.loads(r["__errors"])["items"]} == {
        "temperature fora do intervalo [-10, 55].",
        "holiday_flag fora de {0,1}.",
        "sales_label inválido.",
        "cpi vazio.",
    }
    assert r["__warnings"] == '{"items":[]}'


def test_a_filter_limits_a_rule_and_text_is_coerced_for_ranges(rows):
    rules = [
        quality.Rule("r", "error", "is_in_range", "x", None, 0.0, None, "y = 1"),
        quality.Rule("n", "warn", "is_not_null", "x"),
    ]
    frame = rows("x string, y int", ("-5", 1), ("-5", 0), ("abc", 1), (None, 1), ("3", 1))
    out = quality.label_sets(frame, rules).collect()
    assert [r.set for r in out] == ["Quarantine", "Valid", "Valid", "Quarantine", "Valid"]


def test_column_names_match_in_any_case(rows):
    frame = rows("Store int, Weekly_Sales double", (46, 1.0), (3, 2.0))
    rules = [quality.Rule("r", "error", "is_in_range", "store", None, 1.0, 45.0)]
    labelled = quality.label_sets(frame, rules)
    assert [r.set for r in labelled.collect()] == ["Quarantine", "Valid"]
    assert sales.sales_by_set(labelled).head().valid_sales == 2.0
    with pytest.raises(ValueError):
        quality.label_sets(frame, [quality.Rule("r", "error", "is_not_null", "cpi")])


def test_unknown_functions_and_oversized_catalogues_are_refused(rows, spark):
    with pytest.raises(ValueError):
        quality.label_sets(rows("x int", (1,)), [quality.Rule("r", "error", "is_odd", "x")])
    with pytest.raises(ValueError):
        quality.read_rules(quality.sales_catalogue(spark), at_most=3)


def test_without_rules_or_errors_everything_is_valid(rows):
    frame = rows("x int", (1,), (None,))
    assert {r.set for r in quality.label_sets(frame, []).collect()} == {"Valid"}
    warn = [quality.Rule("n", "warn", "is_not_null", "x")]
    logs = [r["__errors"] for r in quality.label_sets(frame, warn).collect()]
    assert logs == [None, '{"items":[]}']


def test_the_catalogue_table_gives_the_same_rules(spark):
    catalogue = quality.sales_catalogue(spark)
    assert catalogue.count() == 15
    assert quality.read_rules(catalogue) == quality.sales_rules()
    assert tuple(quality.catalogue_counts(catalogue).head()) == (15, 13, 2)
    assert tuple(quality.catalogue_counts(catalogue.drop("criticality")).head()) == (15, 0, 0)
    assert quality.catalogue_view(catalogue.drop("filter")).columns == [
        "name", "criticality", "check", "run_config_name",
    ]


def test_split_is_a_partition(spark):
    sales = views.sales(spark, f"{TESTDATA}/sf0.001")
    valid, quarantine = quality.split(sales, quality.sales_rules(views.LEFT_OUT_RULES))
    assert (valid.count(), quarantine.count()) == (1500 - 169, 169)
    assert valid.join(quarantine, "id").count() == 0
    assert valid.filter("__errors IS NOT NULL OR __warnings IS NOT NULL").count() == 0
    assert quarantine.filter("__errors IS NULL OR __warnings IS NULL").count() == 0


def test_hits_from_logs_equal_direct_counts(spark):
    labelled = views.labelled_sales(spark, f"{TESTDATA}/sf0.001")
    hits = {r.rule: r.n for r in quality.rule_hits(labelled).collect()}
    assert hits == {
        "Temperature_isnt_in_range": 51, "Fuel_Price_is_null": 37, "Holiday_Flag_other_value": 16,
        "Sales_Label_is_null": 19, "Sales_Label_other_value": 21,
    }
    warned = [tuple(r) for r in quality.rule_hits(labelled, "__warnings").collect()]
    assert warned == [("Temperature_is_null", 29)]


@pytest.mark.parametrize(
    "log, counted",
    [
        ('{"items":[{"name":"a"},{"name":"b"}]}', ["a", "b"]),
        ('{"items": [{"name": "a", "column": "c", "message": "m"}], "other": 1}', ["a"]),
        ('{"items":[{"col":1}]}', ["unknown"]),
        ('{"items":[{"name":"a"},{}]}', ["a", "unknown"]),
        ('{"items":[]}', []),
        ('{"items":null}', []),
        ("{}", []),
        ("[1,2]", []),
        ("garbage", []),
        ("", []),
        (None, []),
        ('{"items":"abc"}', []),
        ('{"items":{"name":"a"}}', []),
        ('{"items":[{"name":"a"},5,{"name":"b"}]}', ["a"]),
        ('{"items":[5,{"name":"b"}]}', []),
        ('{"items":[{"name":"a"},null,{"name":"b"}]}', ["a"]),
        ('{"items":[{"name":"a"},"x"]}', ["a"]),
    ],
)
def test_dirty_logs(rows, log, counted):
    frame = rows("log string", (log,), ('{"items":[{"name":"base"}]}',))
    hits = {r.rule: r.n for r in quality.rule_hits(frame, "log").collect()}
    assert hits.pop("base") == 1
    assert hits == {name: counted.count(name) for name in counted}


def test_hits_are_ordered_by_frequency_then_name(rows):
    logs = ['{"items":[{"name":"b"},{"name":"a"},{"name":"c"},{"name":"c"}]}']
    hits = quality.rule_hits(rows("log string", *[(x,) for x in logs]), "log").collect()
    assert [tuple(r) for r in hits] == [("c", 2), ("a", 1), ("b", 1)]


def test_examples_are_the_first_by_id_with_present_columns(spark):
    frame = spark.range(200, 0, -1).select("id", F.lit(1).alias("store"), F.lit(2).alias("x"))
    out = quality.quarantine_examples(frame)
    assert out.columns == ["id", "store"]
    assert [r.id for r in out.collect()] == list(range(1, 81))


def test_rules_that_would_lose_issues_are_refused_by_name(rows):
    for level in ("ERROR", None):
        rule = quality.Rule("odd", level, "is_not_null", "a")
        with pytest.raises(ValueError, match="odd"):
            quality.label_sets(rows("a int", (None,)), [rule])
    broken = rows("name string, criticality string, check string", ("bad", "error", "no json"))
    with pytest.raises(ValueError, match="bad"):
        quality.read_rules(broken)


def test_whole_numbers_are_compared_exactly(rows):
    table = rows("a bigint", (9007199254740993,), (9007199254740992,))
    listed = quality.Rule("r", "error", "is_in_list", "a", allowed=("9007199254740992",))
    assert sorted(r.set for r in quality.label_sets(table, [listed]).collect()) == ["Quarantine", "Valid"]
    bound = quality.Rule("r", "error", "is_in_range", "a", min_limit=0, max_limit=9007199254740992)
    assert sorted(r.set for r in quality.label_sets(table, [bound]).collect()) == ["Quarantine", "Valid"]
    half = quality.Rule("r", "error", "is_in_range", "a", min_limit=0.5)
    assert {r.set for r in quality.label_sets(table, [half]).collect()} == {"Valid"}


def test_a_catalogue_table_with_filters_drives_the_evaluation(rows):
    check = '{"function": "is_not_null", "arguments": {"column": "a"}}'
    checks = rows(
        "name string, criticality string, check string, filter string, run_config_name string",
        ("a_null", "error", check, "b > 1", "default"), ("a_warn", "warn", check, None, "default"),
    )
    table = rows("a int, b int", (None, 1), (None, 2), (5, 2))
    found = quality.with_rule_names(
        quality.label_sets(table, quality.read_rules(checks)), {"__errors": "e", "__warnings": "w"}
    )
    assert sorted((r.b, r.set, r.e, r.w) for r in found.collect() if r.a is None) == [
        (1, "Quarantine", [], ["a_warn"]), (2, "Quarantine", ["a_null"], ["a_warn"])
    ]


def test_logs_that_are_no_json_by_the_letter_are_skipped(rows):
    good = '{"items":[{"name":"a"}]}'
    logs = [good, good + " ", good + " xyz", good + good, good + "," + good, good.replace('"', "'"), "", "[" + good + "]"]
    table = rows("log string", *[(t,) for t in logs])
    assert [tuple(r) for r in quality.rule_hits(table, "log").collect()] == [("a", 2)]


def test_logs_with_anything_behind_the_object_are_skipped(rows):
    good = '{"items":[{"name":"a"}]}'
    bad = [good + tail for tail in ("] trailing garbage", "]", " xyz", ",{}", ",", "}", "],[", '] {"items":[]}', ",[]")]
    bad += ["[" + good + "]", good[:-1], "", "]", "[", "null", "1", good + ',{"end":"x"}', '{"items":"a"}', "{'items':[{'name':'a'}]}"]
    frame = rows("log string", *[(t,) for t in [good, " " + good + "\n", *bad, None]])
    found = quality.rule_hits(frame, "log").collect()
    assert [tuple(r) for r in found] == [("a", 2)]


def test_issues_as_arrays_tell_what_the_logs_tell(rows):
    rules = [quality.Rule("x_null", "error", "is_not_null", "x"), quality.Rule("x_range", "warn", "is_in_range", "x", None, 0.0, 5.0)]
    frame = rows("x int, y string", (1, "a"), (None, "b"), (9, "c"))
    labelled = quality.label_sets(frame, rules, issues=True)
    assert labelled.columns == ["x", "y", "set", "__errors", "__warnings", "error_issues", "warning_issues"]
    for log, issues in (("__errors", "error_issues"), ("__warnings", "warning_issues")):
        assert quality.rule_hits(labelled, log).collect() == quality.rule_hits(labelled, issues).collect()
    plan = quality.rule_hits(labelled, "error_issues")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan.lower() and "to_json" not in plan.lower()
