"""Catalogues evaluated from a table against the same rules as expressions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import quality
from tallyhouse.operators.catalogues import label_sets_from

ROWS = "id bigint, amount decimal(12,2), temp double, ratio float, word string, day date, `odd``name` int"


def _table(rows):
    values = [
        (1, "10.50", 3.0, 0.5, "a", "2024-01-01", 1),
        (2, None, None, None, None, None, None),
        (9007199254740993, "-1.00", float("nan"), float("nan"), "zz", "2024-01-02", 7),
        (-4, "999999.99", -80.5, 1e9, "12", None, 3),
        (5, "0.00", 54.999, 2.0, "", "2024-01-03", 2),
        (5, "0.00", 54.999, 2.0, "", "2024-01-03", 2),
        (6, "3.00", float("inf"), -0.0, "NaN", "2024-01-03", 2),
    ]
    from datetime import date
    from decimal import Decimal

    typed = [(i, a and Decimal(a), t, r, w, d and date.fromisoformat(d), o) for i, a, t, r, w, d, o in values]
    return rows(ROWS, *typed)


def _check(function, column, **arguments):
    return json.dumps({"function": function, "arguments": {"column": column, **arguments}})


def _catalogue(spark, checks):
    made = [(name, level, check, None, "default") for name, level, check in checks]
    return spark.createDataFrame(made, quality.CATALOGUE_SCHEMA)


def _random_checks(n, seed):
    rng = random.Random(seed)
    pools = {"id": [1, 2, 5, 9007199254740992, 9007199254740993, 6], "amount": [10.5, -1, 0, 3, "0.00"],
             "temp": [3, 54.999, "-80.5", 7.25], "ratio": [0.5, 2, 1e9], "word": ["a", "12", "", "zz"], "odd`name": [1, 2, 3]}
    limits = [-90, -4, 0, 0.5, 3, 10.25, 55, 1e6, 123456.75, 1.5e-7, 9007199254740992]
    out = []
    for k in range(n):
        column, kind = rng.choice(list(pools)), rng.randrange(5)
        if kind == 0:
            check = _check("is_not_null", column.upper() if rng.random() < 0.3 else column)
        elif kind < 3:
            sides = rng.choice([("min_limit",), ("max_limit",), ("min_limit", "max_limit"), ()])
            check = _check("is_in_range", column, **{side: rng.choice(limits) for side in sides})
        else:
            pool = pools[column]
            check = _check("is_in_list", column, allowed=rng.sample(pool, rng.randrange(len(pool))))
        out.append((f"rule_{k:05d}", rng.choice(["error", "warn"]), check))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_same_sets_and_logs_as_expressions(spark, rows, seed):
    checks = _catalogue(spark, _random_checks(40, seed))
    table = _table(rows)
    rules = sorted(quality.read_rules(checks), key=lambda rule: rule.name)
    wanted = sorted(map(str, quality.label_sets(table, rules, issues=True).collect()))
    assert sorted(map(str, label_sets_from(table, checks, issues=True).collect())) == wanted


def test_five_thousand_rules_have_the_logs_of_their_parts(spark, rows):
    made, table = _random_checks(5000, 77), _table(rows)
    found = label_sets_from(table, _catalogue(spark, made))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0] and "NestedLoop" not in plan
    names = {}
    for row in found.distinct().collect():
        for log in (row["__errors"], row["__warnings"]):
            names.setdefault(row["id"], []).extend(json.loads(log)["items"] if log else [])
    wanted = {}
    for at in range(0, 5000, 250):
        part = _catalogue(spark, made[at : at + 250])
        for row in quality.label_sets(table, quality.read_rules(part)).distinct().collect():
            for log in (row["__errors"], row["__warnings"]):
                wanted.setdefault(row["id"], []).extend(json.loads(log)["items"] if log else [])
    assert {i: sorted(map(str, own)) for i, own in names.items()} == {i: sorted(map(str, own)) for i, own in wanted.items()}
    assert sum(map(len, names.values())) > 5000


def test_only_dates_that_are_missing_break_rules_on_dates(spark, rows):
    checks = _catalogue(spark, [("day", "warn", _check("is_not_null", "day"))])
    found = label_sets_from(_table(rows), checks).filter(F.col("set") == "Quarantine")
    assert sorted(row["id"] for row in found.collect()) == [-4, 2]
    assert {row["__errors"] for row in found.collect()} == {'{"items":[]}'}


def test_nothing_to_check(spark, rows):
    table, none = _table(rows), _catalogue(spark, [])
    assert {row["set"] for row in label_sets_from(table, none).collect()} == {"Valid"}
    checks = _catalogue(spark, _random_checks(20, 1))
    empty = label_sets_from(table.limit(0), checks, issues=True)
    assert empty.collect() == [] and empty.columns[-5:] == ["set", "__errors", "__warnings", "error_issues", "warning_issues"]


@pytest.mark.parametrize("level, check, where, said", [
    ("error", "no json", None, "cannot be read"),
    ("error", _check("is_new", "id"), None, "unknown function"),
    ("fatal", _check("is_not_null", "id"), None, "unknown criticality"),
    (None, _check("is_not_null", "id"), None, "unknown criticality"),
    ("warn", _check("is_not_null", "other"), None, "lacks"),
    ("warn", _check("is_not_null", "id"), "id > 1", "filter"),
    ("warn", _check("is_in_list", "day", allowed=["2024-01-01"]), None, "type"),
    ("warn", _check("is_in_list", "id", allowed=["one"]), None, "no number"),
])
def test_rules_that_are_refused(spark, rows, level, check, where, said):
    checks = spark.createDataFrame([("r", level, check, where, "default")], quality.CATALOGUE_SCHEMA)
    with pytest.raises(ValueError, match=said):
        label_sets_from(_table(rows), checks)


def test_a_catalogue_beyond_the_bound_is_refused(spark, rows):
    with pytest.raises(ValueError, match="more than 10"):
        label_sets_from(_table(rows), _catalogue(spark, _random_checks(11, 3)), at_most=10)
