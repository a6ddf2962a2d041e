"""Rules as data: catalogues of thousands of rules, evaluated from a table instead of SQL text.

``quality.label_sets`` turns every rule into an expression, which stops being compiled, and in
the end being planned, when there are thousands. Here the catalogue stays a table. It is
grouped into one row per governed column, with the column's envelope: the largest lower and the
smallest upper limit of its ranges, and what all its lists have in common. A value breaks some
rule exactly when it lies outside the envelope, so telling the sets apart takes a few comparisons
a column, however many rules there are; the rules themselves are gone through only for the
columns of a row that lie outside. It is one projection without a shuffle or a row id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallyhouse.functions.lineage import cut
from tallyhouse.functions.numbers import column_type
from tallyhouse.operators.frames import QUARANTINE, VALID
from tallyhouse.operators.quality import ERROR, WARN, parse_catalogue

NOT_NULL, IN_RANGE, IN_LIST = "is_not_null", "is_in_range", "is_in_list"
INTEGER, EXACT, NEAR, TEXT, OTHER = "integer", "exact", "near", "text", "other"
# How the kinds of columns compare with lists, and those of exact values with whole limits.
LISTED = {INTEGER: "bigint", EXACT: "decimal(38,18)", NEAR: "double", TEXT: "string"}
WHOLE = {INTEGER: "bigint", EXACT: "decimal(19,0)"}


def label_sets_from(df: DataFrame, checks: DataFrame, at_most: int = 100_000, issues: bool = False) -> DataFrame:
    """What ``quality.label_sets`` adds, for the rules of a catalogue table, listed by name.

    Sets, logs and ``issues`` are those of ``quality.label_sets`` for the same rules in the order
    of name, column and message; limits in messages that are no ties at six digits are equal too.
    An empty catalogue leaves every row valid.

    The catalogue is read when this is called; the driver gets the names of the columns it
    governs, and the tasks the whole of it, which is why more than ``at_most`` rules are
    refused. So are, by name, rules that cannot be read, of an unknown function or criticality,
    on columns the table lacks, with numbers that are none, and those that need an expression:
    rules with a ``filter``, and limits or lists on dates, flags and decimals beyond twenty
    digits before the point or eighteen behind it.
    """
    kinds = {field.name.lower(): _kind(field.dataType) for field in df.schema}
    columns = _by_column(_typed(checks, kinds, at_most))
    governed = sorted(row["key"] for row in columns.select("key").collect())
    rules = {key: columns.filter(F.col("key") == key).select(F.struct(*columns.columns)).scalar() for key in governed}
    outside = {key: _outside(key, kinds[key], rules[key]) for key in governed}
    broken = reduce(Column.__or__, outside.values(), F.lit(False))

    # A projection of their own, since lambdas take no subqueries: only rows outside carry rules, for one step.
    carried = {(key, level): f"_{level}_rules_of_{key}" for key in governed for level in (ERROR, WARN)}
    taken = {name: F.when(outside[key], rules[key][level]) for (key, level), name in carried.items()}

    def items(level: str) -> Column:
        found = [
            F.filter(_quoted(carried[key, level]), lambda rule: _breaks(key, kinds[key], rule))  # noqa: B023
            for key in governed
        ]
        issue = [
            F.transform(
                F.coalesce(some, F.array()),
                lambda rule: F.struct(*[rule[c].alias(c) for c in ("name", "column", "message")]),
            )
            for some in found
        ]
        nothing = F.from_json(F.lit("[]"), "array<struct<name:string,column:string,message:string>>")
        return F.sort_array(F.concat(*issue)) if issue else nothing

    added = {"set": F.when(broken, QUARANTINE).otherwise(VALID)}
    for name, level in (("errors", ERROR), ("warnings", WARN)):
        added[f"__{name}"] = F.when(broken, F.to_json(F.struct(items(level).alias("items"))))
    if issues:
        for name, level in (("error_issues", ERROR), ("warning_issues", WARN)):
            added[name] = F.when(broken, items(level))
    return df.withColumns(taken).withColumns(added).drop(*taken)


def _kind(kind) -> str:
    if isinstance(kind, DecimalType):
        return EXACT if kind.precision - kind.scale <= 20 and kind.scale <= 18 else OTHER
    name = kind.simpleString()
    if name in ("tinyint", "smallint", "int", "bigint"):
        return INTEGER
    return {"float": NEAR, "double": NEAR, "string": TEXT}.get(name, OTHER)


def _typed(checks: DataFrame, kinds: dict[str, str], at_most: int) -> DataFrame:
    """The catalogue with limits and lists as its columns compare with them; raises on what it cannot hold."""
    parsed = parse_catalogue(checks)
    if column_type(parsed, "filter") is None:
        parsed = parsed.withColumn("filter", F.lit(None).cast("string"))
    by_name = F.create_map(*[F.lit(part) for pair in kinds.items() for part in pair])
    parsed = parsed.withColumn("key", F.lower("column")).withColumn("kind", by_name[F.col("key")])
    lists = F.coalesce("allowed", F.array().cast("array<string>"))
    numbers = {INTEGER: LISTED[EXACT], EXACT: LISTED[EXACT], NEAR: LISTED[NEAR]}
    typed = {}
    for kind, compared in LISTED.items():
        values = F.transform(lists, lambda v: v.try_cast(numbers.get(kind, compared)))  # noqa: B023
        if kind == INTEGER:  # no whole number equals the others
            values = F.transform(F.filter(values, lambda v: F.coalesce(v == F.floor(v), F.lit(False))), lambda v: v.try_cast(compared))  # noqa: B023
        typed[f"listed_{kind}"] = F.when((F.col("function") == IN_LIST) & (F.col("kind") == kind), values)
    for side in ("min", "max"):
        limit = F.when(F.col("function") == IN_RANGE, F.col(f"{side}_limit"))
        whole = (limit == F.floor(limit)) & (F.abs(limit) < 1e18)
        for kind, compared in WHOLE.items():
            typed[f"{side}_{kind}"] = F.when(whole & (F.col("kind") == kind), limit.try_cast(compared))
        typed[f"{side}_near"] = F.when(~F.coalesce(whole & F.col("kind").isin(*WHOLE), F.lit(False)), limit)
    rules = parsed.withColumns(typed)
    no_number = (F.col("function") == IN_LIST) & F.col("kind").isin(*numbers) & F.when(
        F.col("kind") == NEAR, F.exists(lists, lambda v: v.try_cast(LISTED[NEAR]).isNull())
    ).otherwise(F.exists(lists, lambda v: v.try_cast(LISTED[EXACT]).isNull()))
    wrong = (
        F.when(F.col("function").isNull() | F.col("key").isNull(), "check cannot be read")
        .when(~F.col("function").isin(NOT_NULL, IN_RANGE, IN_LIST), "unknown function")
        .when(~F.coalesce(F.col("criticality").isin(ERROR, WARN), F.lit(False)), "unknown criticality")
        .when(F.col("kind").isNull(), "column the table lacks")
        .when(F.col("filter").isNotNull(), "a filter needs quality.label_sets")
        .when((F.col("function") != NOT_NULL) & (F.col("kind") == OTHER), "this type needs quality.label_sets")
        .when(no_number, "no number")
    )
    rules = cut(rules.withColumns({"message": _message(), "wrong": wrong}))
    if rules.limit(at_most + 1).count() > at_most:
        raise ValueError(f"more than {at_most} rules")
    refused = rules.filter("wrong IS NOT NULL").select("name", "wrong").orderBy("name").limit(20).collect()
    if refused:
        raise ValueError(f"rules refused: {[tuple(row) for row in refused]}")
    return rules


def _message() -> Column:
    """Text of an issue. The wording users of the logs know."""
    column, limits = F.col("column"), F.concat_ws(", ", _short("min_limit"), _short("max_limit"))
    numbers = F.concat(column, F.lit(" fora de {"), F.array_join("allowed", ","), F.lit("}."))
    bare = F.concat(column, F.lit(" fora de {}."))
    return (
        F.when(F.col("function") == NOT_NULL, F.concat(column, F.lit(" vazio.")))
        .when(F.col("function") == IN_RANGE, F.concat(column, F.lit(" fora do intervalo ["), limits, F.lit("].")))
        .when(F.col("kind") != TEXT, F.coalesce(numbers, bare))
        .otherwise(F.concat(column, F.lit(" inválido.")))
    )


def _short(limit: str) -> Column:
    """A limit with six significant digits, without zeros at the end; a missing one is empty."""
    parts = F.split(F.format_string("%.5e", F.col(limit)), "e")
    power = F.get(parts, 1).try_cast("int")
    fixed = F.call_function(
        "format_string", F.concat(F.lit("%."), F.greatest(5 - power, F.lit(0)).cast("string"), F.lit("f")), F.col(limit)
    )

    def bare(number: Column) -> Column:
        return F.when(number.contains("."), F.regexp_replace(number, r"\.?0+$", "")).otherwise(number)

    return (
        F.when(F.col(limit).isNull(), "")
        .when(power.between(-4, 5), bare(fixed))
        .otherwise(F.concat(bare(F.get(parts, 0)), F.lit("e"), F.get(parts, 1)))
    )


def _by_column(rules: DataFrame) -> DataFrame:
    """One row a governed column: its envelope, and its rules by criticality."""
    forms = (*WHOLE, "near")
    limits = [f"{side}_{form}" for side in ("min", "max") for form in forms]
    rule = F.struct("name", "column", "message", "function", *limits, *[f"listed_{kind}" for kind in LISTED])

    def shared(kind: str) -> Column:
        lists = F.collect_list(f"listed_{kind}")
        return F.aggregate(lists, F.get(lists, 0), lambda common, own: F.array_intersect(common, own))

    return cut(rules.groupBy("key").agg(
        F.bool_or(F.col("function") == NOT_NULL).alias("needed"),
        *[F.max(f"min_{form}").alias(f"min_{form}") for form in forms],
        *[F.min(f"max_{form}").alias(f"max_{form}") for form in forms],
        *[shared(kind).alias(f"listed_{kind}") for kind in LISTED],
        *[F.collect_list(F.when(F.col("criticality") == level, rule)).alias(level) for level in (ERROR, WARN)],
    ))


def _missing(key: str, kind: str) -> Column:
    value = F.col(_quoted(key))
    return value.isNull() | F.isnan(value) if kind == NEAR else value.isNull()


def _beyond(key: str, kind: str, rule: Column) -> Column:
    """TRUE where a present value lies outside the limits or the list in the fields of ``rule``."""
    value = F.col(_quoted(key))
    number = value.try_cast("double") if kind == TEXT else value.cast("double")
    broken = (number < rule["min_near"]) | (number > rule["max_near"])
    if kind in WHOLE:
        broken = broken | (value < rule[f"min_{kind}"]) | (value > rule[f"max_{kind}"])
    broken = broken | ~F.array_contains(rule[f"listed_{kind}"], value.cast(LISTED[kind]))
    return F.coalesce(broken, F.lit(False)) & ~_missing(key, kind)


def _outside(key: str, kind: str, column: Column) -> Column:
    """Whether the value breaks any rule of its column."""
    absent = column["needed"] & _missing(key, kind)
    return absent if kind == OTHER else absent | _beyond(key, kind, column)


def _breaks(key: str, kind: str, rule: Column) -> Column:
    absent = (rule["function"] == NOT_NULL) & _missing(key, kind)
    return absent if kind == OTHER else absent | _beyond(key, kind, rule)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
