"""Declarative quality rules: catalogue, evaluation, split, and counts from issue logs.

A rule is a row ``(name, criticality, check, filter, run_config_name)`` whose ``check``
is JSON such as ``{"function": "is_in_range", "arguments": {"column": "temperature",
"min_limit": -10, "max_limit": 55}}``. A NULL value breaks only ``is_not_null``; ranges
include their ends; lists compare exactly. A rule with a ``filter`` applies where that
SQL predicate holds.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import column_type, identifier, literal
from tallyhouse.operators.frames import QUARANTINE, VALID, present_columns
from tallyhouse.sources.tables import first_rows

ERROR = "error"
WARN = "warn"
UNKNOWN_RULE = "unknown"
EXAMPLE_ROWS = 80

CATALOGUE_COLUMNS = ("name", "criticality", "check", "filter", "run_config_name")
CATALOGUE_SCHEMA = ", ".join(f"{name} string" for name in CATALOGUE_COLUMNS)
CHECK_SCHEMA = (
    "function string, arguments struct<column:string,allowed:array<string>,"
    "min_limit:double,max_limit:double>"
)
_MARK = "end of log 5b1f9c07"  # in no log
_ITEMS = "array<struct<name:string,column:string,message:string>>"
_EXACT = {"tinyint", "smallint", "int", "bigint", "decimal"}
_NUMERIC = _EXACT | {"float", "double"}
# The columns of an example row.
EXAMPLE_COLUMNS = (
    "id", "store", "sale_date", "weekly_sales", "holiday_flag", "temperature", "fuel_price",
    "cpi", "unemployment", "sales_label", "__errors", "__warnings",
)

# The standard rules of the sales table, as name, criticality, check.
SALES_RULES = [
    ("Sales_Label_is_null", ERROR, "is_not_null", {"column": "sales_label"}),
    ("Sales_Label_other_value", ERROR, "is_in_list",
     {"column": "sales_label", "allowed": ["High", "Medium", "Low"]}),
    ("Holiday_Flag_is_null", WARN, "is_not_null", {"column": "holiday_flag"}),
    ("Fuel_Price_is_null", ERROR, "is_not_null", {"column": "fuel_price"}),
    ("Temperature_isnt_in_range", ERROR, "is_in_range",
     {"column": "temperature", "min_limit": -10, "max_limit": 55}),
    ("Temperature_is_null", WARN, "is_not_null", {"column": "temperature"}),
    ("Unemployment_is_null", ERROR, "is_not_null", {"column": "unemployment"}),
    ("id_is_null", ERROR, "is_not_null", {"column": "id"}),
    ("id_isnt_in_range", ERROR, "is_in_range",
     {"column": "id", "min_limit": 1, "max_limit": 6435}),
    ("Store_is_null", ERROR, "is_not_null", {"column": "store"}),
    ("Store_isnt_in_range", ERROR, "is_in_range",
     {"column": "store", "min_limit": 1, "max_limit": 45}),
    ("Date_is_null", ERROR, "is_not_null", {"column": "sale_date"}),
    ("Weekly_Sales_is_null", ERROR, "is_not_null", {"column": "weekly_sales"}),
    ("Holiday_Flag_other_value", ERROR, "is_in_list",
     {"column": "holiday_flag", "allowed": [0, 1]}),
    ("CPI_is_null", ERROR, "is_not_null", {"column": "cpi"}),
]


@dataclass(frozen=True)
class Rule:
    """One rule of the catalogue, ready to become an expression."""

    name: str
    criticality: str
    function: str
    column: str
    allowed: tuple[str, ...] | None = None
    min_limit: float | None = None
    max_limit: float | None = None
    where: str | None = None


# --- catalogue ---------------------------------------------------------------------


def sales_rules(leave_out: Sequence[str] = ()) -> list[Rule]:
    """The standard sales rules."""
    return [
        Rule(
            name,
            level,
            function,
            arguments["column"],
            tuple(str(v) for v in arguments["allowed"]) if "allowed" in arguments else None,
            arguments.get("min_limit"),
            arguments.get("max_limit"),
        )
        for name, level, function, arguments in SALES_RULES
        if name not in leave_out
    ]


def sales_catalogue(spark: SparkSession, leave_out: Sequence[str] = ()) -> DataFrame:
    """The standard sales rules as a catalogue table."""
    rows = [
        (name, level, json.dumps({"function": function, "arguments": arguments}), None, "default")
        for name, level, function, arguments in SALES_RULES
        if name not in leave_out
    ]
    return spark.createDataFrame(rows, CATALOGUE_SCHEMA)


def parse_catalogue(checks: DataFrame) -> DataFrame:
    """Catalogue with its JSON checks as typed columns; unreadable parts are NULL."""
    parsed = F.from_json("check", CHECK_SCHEMA)
    kept = [c for c in CATALOGUE_COLUMNS if c != "check" and c in checks.columns]
    return checks.withColumn("parsed", parsed).select(
        *kept,
        F.col("parsed.function").alias("function"),
        F.col("parsed.arguments.column").alias("column"),
        F.col("parsed.arguments.allowed").alias("allowed"),
        F.col("parsed.arguments.min_limit").alias("min_limit"),
        F.col("parsed.arguments.max_limit").alias("max_limit"),
    )


def catalogue_view(checks: DataFrame) -> DataFrame:
    """The catalogue columns that exist, as stored."""
    return present_columns(checks, CATALOGUE_COLUMNS)


def catalogue_counts(checks: DataFrame) -> DataFrame:
    """One row: rules in total, errors and warnings (0 without a criticality column)."""
    if column_type(checks, "criticality") is not None:
        errors, warnings = (
            F.count_if(F.col("criticality") == level) for level in (ERROR, WARN)
        )
    else:
        errors = warnings = F.lit(0).cast("bigint")
    return checks.agg(
        F.count("*").alias("rules"), errors.alias("errors"), warnings.alias("warnings")
    )


def read_rules(checks: DataFrame, at_most: int = 1000) -> list[Rule]:
    """The catalogue as rules. This is metadata and the one thing brought to the driver.

    More than ``at_most`` rows are refused: such a table is data, not a catalogue. So is,
    by name, a rule whose check is no readable JSON with a function and a column.
    """
    rows = parse_catalogue(checks).limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} rows")
    unreadable = [row["name"] for row in rows if row["function"] is None or row["column"] is None]
    if unreadable:
        raise ValueError(f"rules whose check cannot be read: {unreadable}")
    return [
        Rule(
            row["name"],
            row["criticality"],
            row["function"],
            row["column"],
            None if row["allowed"] is None else tuple(row["allowed"]),
            row["min_limit"],
            row["max_limit"],
            row.asDict().get("filter"),
        )
        for row in rows
    ]


# --- evaluation --------------------------------------------------------------------


def violated(rule: Rule, kind: str) -> str:
    """SQL predicate: TRUE where a row breaks the rule, else FALSE or NULL. NaN is missing."""
    value = identifier(rule.column)
    may_be_nan = kind in ("double", "float")
    if rule.function == "is_not_null":
        broken = f"{value} IS NULL" + (f" OR isnan({value})" if may_be_nan else "")
    elif rule.function == "is_in_range":
        number = f"try_cast({value} AS DOUBLE)" if kind == "string" else value
        limits = [("<", rule.min_limit), (">", rule.max_limit)]
        outside = [f"{number} {sign} {_limit(limit, kind)}" for sign, limit in limits if limit is not None]
        broken = " OR ".join(outside) or "FALSE"
    elif rule.function == "is_in_list":
        allowed = ", ".join(
            _allowed(v, kind) if kind in _NUMERIC else literal(v) for v in rule.allowed or ()
        )
        broken = f"{value} NOT IN ({allowed})" if allowed else f"{value} IS NOT NULL"
    else:
        raise ValueError(f"rule {rule.name!r}: unknown function {rule.function!r}")
    if may_be_nan and rule.function != "is_not_null":
        broken = f"({broken}) AND NOT isnan({value})"
    return f"(({rule.where}) AND ({broken}))" if rule.where is not None else f"({broken})"


def _limit(limit: float, kind: str) -> str:
    """A bound as a literal that whole-number and decimal columns compare exactly with."""
    if kind in _EXACT and float(limit).is_integer() and abs(limit) < 1e18:
        return f"{int(limit)}BD"
    return f"{float(limit)!r}D"


def _allowed(text: str, kind: str) -> str:
    """A listed number as a literal; exact next to whole-number and decimal columns."""
    if kind in _EXACT:
        value = Decimal(text)
        if len(value.as_tuple().digits) <= 38 and value.as_tuple().exponent >= -18:
            return f"{value:f}BD"
    return f"{float(text)!r}D"


def message(rule: Rule, kind: str) -> str:
    """Text of an issue. The wording users of the logs know."""
    if rule.function == "is_not_null":
        return f"{rule.column} vazio."
    if rule.function == "is_in_range":
        limits = ", ".join("" if v is None else f"{v:g}" for v in (rule.min_limit, rule.max_limit))
        return f"{rule.column} fora do intervalo [{limits}]."
    if kind in _NUMERIC:
        return f"{rule.column} fora de {{{','.join(rule.allowed or ())}}}."
    return f"{rule.column} inválido."


def label_sets(df: DataFrame, rules: Sequence[Rule], issues: bool = False) -> DataFrame:
    """Adds ``set``, ``__errors`` and ``__warnings``.

    A row that breaks any rule, error or warning, is Quarantine and carries both logs as
    JSON ``{"items": [...]}`` (possibly empty); any other row is Valid with NULL logs.
    It is one projection without shuffle. ``set`` depends on the bare conditions, so a
    query that does not use the logs never builds them. ``issues`` adds what the logs are
    written from, the arrays ``error_issues`` and ``warning_issues`` of ``(name, column,
    message)``, for plans that count or list issues without reading JSON again.
    """
    unknown = {rule.name: rule.criticality for rule in rules if rule.criticality not in (ERROR, WARN)}
    if unknown:
        raise ValueError(f"rules with a criticality other than {ERROR} and {WARN}: {unknown}")
    kinds = {rule.column: column_type(df, rule.column) for rule in rules}
    absent = [name for name, kind in kinds.items() if kind is None]
    if absent:
        raise ValueError(f"rules on columns the table lacks: {absent}")
    kinds = {name: kind.split("(")[0] for name, kind in kinds.items()}
    broken = [violated(rule, kinds[rule.column]) for rule in rules]
    marked = df.withColumn("_broken", F.expr(" OR ".join(broken) or "FALSE"))

    def items(level: str) -> str:
        found = ", ".join(
            f"CASE WHEN {condition} THEN named_struct('name', {literal(rule.name)}, 'column', "
            f"{literal(rule.column)}, 'message', {literal(message(rule, kinds[rule.column]))}) END"
            for rule, condition in zip(rules, broken)
            if rule.criticality == level
        )
        return f"array_compact(array({found}))" if found else f"from_json('[]', '{_ITEMS}')"

    def log(level: str) -> Column:
        return F.expr(f"CASE WHEN _broken THEN to_json(named_struct('items', {items(level)})) END")

    label = F.expr(f"CASE WHEN _broken THEN {literal(QUARANTINE)} ELSE {literal(VALID)} END")
    added = {"set": label, "__errors": log(ERROR), "__warnings": log(WARN)}
    if issues:
        for name, level in (("error_issues", ERROR), ("warning_issues", WARN)):
            added[name] = F.expr(f"CASE WHEN _broken THEN {items(level)} END")
    return marked.withColumns(added).drop("_broken")


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid and quarantined rows, each as its own table."""
    labelled = label_sets(df, rules)
    valid = labelled.filter(F.col("set") == VALID).drop("set")
    quarantine = labelled.filter(F.col("set") == QUARANTINE).drop("set")
    return valid, quarantine


# --- issue logs --------------------------------------------------------------------


def rule_hits(df: DataFrame, log: str = "__errors") -> DataFrame:
    """How often each rule name occurs in a column of issues, most frequent first.

    The column holds JSON issue logs, or arrays of issues as ``label_sets`` makes them. An
    item without a name counts as ``unknown`` (also one whose name is NULL). Logs that are
    no such JSON are skipped. In a log with an item that is no object, the items before it
    count, as if it were read from left to right.
    """
    # The outer form: a plain explode makes Spark filter for non-empty arrays first,
    # and that filter would parse every log a second time below the projection.
    return (
        with_rule_names(df.select(log), {log: "names"})
        .select(F.explode_outer("names").alias("rule"))
        .filter(F.col("rule").isNotNull())
        .groupBy("rule")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "rule")
    )


def with_rule_names(df: DataFrame, logs: Mapping[str, str]) -> DataFrame:
    """Adds for each column of issues an array of the rule names in it; NULL for other text.

    Each JSON log is parsed once, into the texts of its items, up to the first that is no object.
    """
    for log, names in logs.items():
        if column_type(df, log) == "string":
            items = f"_{names}_items"
            df = df.withColumn(items, _log_items(log))
            objects = F.transform(items, lambda item: F.coalesce(item.startswith("{"), F.lit(False)))
            bad = F.array_position(objects, F.lit(False))
            whole = F.slice(items, F.lit(1), F.when(bad == 0, F.size(items)).otherwise(bad - 1).cast("int"))
            found = F.transform(whole, lambda item: F.from_json(item, "name string")["name"])
        else:
            items, found = None, F.transform(log, lambda issue: issue["name"])
        df = df.withColumn(names, F.transform(found, lambda name: F.coalesce(name, F.lit(UNKNOWN_RULE))))
        df = df.drop(items) if items else df
    return df


def _log_items(log: str) -> Column:
    """The texts of the items of a log that is one JSON object by the letter, else NULL.

    The log is read as the first of two elements of an array whose second is a mark, so
    nothing can stand behind the object: whatever closes or follows it hides or moves the mark.
    """
    whole = F.concat(F.lit("["), F.col(log), F.lit(f',{{"{_MARK}":"{_MARK}"}}]'))
    kind = f"array<struct<items:array<string>,`{_MARK}`:string>>"
    parsed = F.from_json(whole, kind, {"allowSingleQuotes": "false"})
    marked = (F.size(parsed) == 2) & (F.get(parsed, 1)[_MARK] == _MARK) & F.get(parsed, 0)[_MARK].isNull()
    return F.when(marked, F.get(parsed, 0)["items"])


def quarantine_examples(quarantine: DataFrame, n: int = EXAMPLE_ROWS) -> DataFrame:
    """The first ``n`` quarantined rows by id, then sale date and store, with the columns that exist."""
    order = present_columns(quarantine, ["id", "sale_date", "store"]).columns
    return present_columns(first_rows(quarantine, order, n), EXAMPLE_COLUMNS)
