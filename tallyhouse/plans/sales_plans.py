"""Registered queries on sales, rules, logs and questions, each with its SQL twin."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyhouse.functions.numbers import exact_sum
from tallyhouse.functions.text import billions_text, dotted_text, percent_text
from tallyhouse.operators import quality, questions, sales, zones
from tallyhouse.operators.catalogues import label_sets_from
from tallyhouse.operators.frames import QUARANTINE, VALID, apply_filters, drop_missing, stack_sets
from tallyhouse.plans import views
from tallyhouse.plans.trip_plans import rolling_sql
from tallyhouse.sources import tables

FIRST, LAST = date(1996, 1, 1), date(1996, 12, 31)
STORES = (3, 7, 45)
METRIC = "temperature"

QUERIES = {}
ORACLES = {}


def _query(oracle: str, name: str | None = None):
    def register(build):
        key = name or build.__name__
        QUERIES[key] = build
        ORACLES[key] = oracle
        return build

    return register


def _total(column: str, condition: str | None = None) -> str:
    filtered = f" FILTER ({condition})" if condition else ""
    return f"CAST(COALESCE(SUM(CAST({column} AS DECIMAL(18,2))){filtered}, 0) AS DOUBLE)"


def _mean(column: str) -> str:
    return f"{_total(column)} / NULLIF(COUNT({column}), 0)"


# --- sources and filters -----------------------------------------------------------


@_query(views.oracle("""
SELECT id, CAST(TRY_CAST(sale_date AS TIMESTAMP) AS DATE) AS sale_date,
       CASE WHEN NOT isnan(temperature) THEN temperature END AS temperature FROM raw_v""",
    raw_v=views.RAW_SALES))
def source_normalised(spark, sf_dir):
    """Unreadable dates and NaN as NULL; from the catalog if it has the table, else a path."""
    orders = tables.load(spark, "tallyhouse_orders", f"{sf_dir}/orders.parquet")
    return tables.normalise(tables.query(spark, views.RAW_SALES, orders=orders))


def _filtered_sql(stores: str) -> str:
    return views.oracle(f"""
SELECT * FROM sales_v WHERE sale_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}' {stores}""",
        sales_v=views.SALES)


@_query(_filtered_sql(""))
def filtered_sales(spark, sf_dir):
    """Sales of a date range, both days included."""
    return apply_filters(views.sales(spark, sf_dir), FIRST, LAST)


@_query(_filtered_sql(f"AND store IN {STORES}"))
def filtered_sales_of_stores(spark, sf_dir):
    """Sales of a date range and of chosen stores."""
    return apply_filters(views.sales(spark, sf_dir), FIRST, LAST, STORES)


@_query(views.sales_oracle("""
SELECT id, temperature, fuel_price, sales_label FROM sales_v
WHERE temperature IS NOT NULL AND fuel_price IS NOT NULL AND sales_label IS NOT NULL"""))
def complete_sales(spark, sf_dir):
    """Sales rows without a missing value in any of the chosen columns."""
    chosen = views.sales(spark, sf_dir).select("id", "temperature", "fuel_price", "sales_label")
    return drop_missing(chosen)


@_query(views.sales_oracle("""
SELECT "set", id, sales_label, CASE WHEN "set" = 'Quarantine' THEN temperature END AS temperature
FROM labelled"""))
def stacked_sets(spark, sf_dir):
    """Both sets under one another; a column that only one of them has is NULL elsewhere."""
    rules = quality.sales_rules(views.LEFT_OUT_RULES)
    valid, quarantine = quality.split(views.sales(spark, sf_dir), rules)
    return stack_sets(
        valid.select("id", "sales_label"), quarantine.select("temperature", "sales_label", "id")
    )


# --- sets, trend, holiday, profile -------------------------------------------------

_SHARES = """
SELECT COUNT(*) AS total_rows, COUNT(*) FILTER ("set" = 'Valid') AS valid_rows,
       COUNT(*) FILTER ("set" = 'Quarantine') AS quarantine_rows,
       COALESCE(COUNT(*) FILTER ("set" = 'Valid') / NULLIF(COUNT(*), 0) * 100.0, 0) AS valid_pct,
       COALESCE(COUNT(*) FILTER ("set" = 'Quarantine') / NULLIF(COUNT(*), 0) * 100.0, 0)
         AS quarantine_pct
FROM labelled"""

_BY_SET = (
    "SELECT " + _total("weekly_sales", "\"set\" = 'Valid'") + " AS valid_sales, "
    + _total("weekly_sales", "\"set\" = 'Quarantine'") + " AS quarantine_sales FROM labelled"
)


@_query(views.sales_oracle(_SHARES))
def set_shares(spark, sf_dir):
    """Rows and shares of both sets."""
    return sales.set_shares(views.labelled_sales(spark, sf_dir))


@_query(views.sales_oracle(_BY_SET))
def sales_by_set(spark, sf_dir):
    """Sales sum of both sets."""
    return sales.sales_by_set(views.labelled_sales(spark, sf_dir))


def _text_sales(spark, sf_dir):
    raw = views.view(spark, sf_dir, views.TEXT_SALES, "orders")
    return raw.withColumnRenamed("data_set", "set")


@_query(views.oracle(
    "SELECT " + _total("TRY_CAST(weekly_sales AS DOUBLE)", "data_set = 'Valid'")
    + " AS valid_sales, " + _total("TRY_CAST(weekly_sales AS DOUBLE)", "data_set = 'Quarantine'")
    + " AS quarantine_sales FROM text_v", text_v=views.TEXT_SALES))
def sales_by_set_from_text(spark, sf_dir):
    """Sales sum of both sets where the amounts are text, some of it unreadable."""
    return sales.sales_by_set(_text_sales(spark, sf_dir))


@_query(views.sales_oracle(f"""
SELECT sale_date, "set", {_total("weekly_sales")} AS weekly_sales FROM labelled GROUP BY 1, 2"""))
def sales_trend(spark, sf_dir):
    """Sales sum per week and set."""
    return sales.sales_trend(views.labelled_sales(spark, sf_dir))


@_query(views.sales_oracle(f"""
SELECT CASE holiday_flag WHEN 0 THEN 'Sem feriado' ELSE 'Com feriado' END AS holiday,
       {_mean("weekly_sales")} AS avg_sales, "set"
FROM labelled WHERE holiday_flag IN (0, 1) GROUP BY holiday_flag, "set" """))
def holiday_effect(spark, sf_dir):
    """Mean sales with and without holiday per set."""
    return sales.holiday_effect(views.labelled_sales(spark, sf_dir))


@_query(views.oracle(f"""
SELECT CASE flag WHEN 0 THEN 'Sem feriado' ELSE 'Com feriado' END AS holiday,
       {_mean("TRY_CAST(weekly_sales AS DOUBLE)")} AS avg_sales, data_set AS "set"
FROM (SELECT *, TRY_CAST(holiday_flag AS DOUBLE) AS flag FROM text_v)
WHERE flag IN (0, 1) GROUP BY flag, data_set""", text_v=views.TEXT_SALES))
def holiday_effect_from_text(spark, sf_dir):
    """Mean sales by holiday where flags and amounts are text, some of it unreadable."""
    return sales.holiday_effect(_text_sales(spark, sf_dir))


def _profile_sql(metric: str) -> str:
    return f"""SELECT sale_date, "set", {_mean(metric)} AS {metric},
       {_mean("weekly_sales")} AS weekly_sales FROM labelled GROUP BY 1, 2"""


def _profile_query(metric: str):
    def build(spark, sf_dir):
        return sales.daily_profile(views.labelled_sales(spark, sf_dir), metric)

    build.__doc__ = f"Mean {metric} and mean sales per week and set."
    build.__name__ = "daily_profile" if metric == METRIC else f"daily_profile_{metric}"
    return _query(views.sales_oracle(_profile_sql(metric)))(build)


daily_profile = _profile_query(METRIC)
for _metric in ("fuel_price", "unemployment", "cpi"):
    _profile_query(_metric)


@_query(views.sales_oracle(f"""
SELECT sale_date, "set", {METRIC}, weekly_sales FROM (
  SELECT sale_date, "set", {METRIC}, {rolling_sql("weekly_sales")},
         COUNT(weekly_sales) OVER w AS n
  FROM ({_profile_sql(METRIC)})
  WINDOW w AS (PARTITION BY "set" ORDER BY sale_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
WHERE n = 7"""))
def daily_profile_rolling7(spark, sf_dir):
    """Profile with mean sales smoothed over seven dates per set."""
    return sales.daily_profile_rolling(daily_profile(spark, sf_dir), METRIC)


# --- stores and dates --------------------------------------------------------------


@_query(views.sales_oracle(f"""
SELECT store, {_total("weekly_sales")} AS weekly_sales FROM labelled WHERE "set" = 'Valid'
GROUP BY store ORDER BY weekly_sales DESC, store LIMIT 12"""))
def top_stores(spark, sf_dir):
    """The twelve stores with the highest valid sales."""
    valid = views.labelled_sales(spark, sf_dir).filter(F.col("set") == VALID)
    return sales.top_stores(valid)


def _offenders_sql(n: int) -> str:
    return views.sales_oracle(f"""
SELECT store, COUNT(*) AS n FROM labelled WHERE "set" = 'Quarantine'
GROUP BY store ORDER BY n DESC, store LIMIT {n}""")


def _quarantined(spark, sf_dir):
    return views.labelled_sales(spark, sf_dir).filter(F.col("set") == QUARANTINE)


@_query(_offenders_sql(8))
def top_offenders(spark, sf_dir):
    """The eight stores with most quarantined rows."""
    return sales.top_offenders(_quarantined(spark, sf_dir))


@_query(_offenders_sql(10))
def top_offenders_ten(spark, sf_dir):
    """The ten stores with most quarantined rows."""
    return sales.top_offenders(_quarantined(spark, sf_dir), 10)


@_query(views.oracle("""
SELECT TRY_CAST(TRUNC(TRY_CAST(store AS DOUBLE)) AS INT) AS store, COUNT(*) AS n FROM text_v
WHERE TRY_CAST(TRUNC(TRY_CAST(store AS DOUBLE)) AS INT) IS NOT NULL GROUP BY 1""", text_v=views.TEXT_SALES))
def rows_per_store(spark, sf_dir):
    """Rows per store where stores are text, some of it no number."""
    return sales.rows_per_store(_text_sales(spark, sf_dir))


@_query(views.sales_oracle(
    "SELECT MIN(sale_date) AS first_day, MAX(sale_date) AS last_day FROM labelled"))
def date_bounds(spark, sf_dir):
    """First and last week over both sets."""
    return sales.date_bounds(views.labelled_sales(spark, sf_dir))


@_query(views.sales_oracle("SELECT DISTINCT store FROM labelled WHERE store IS NOT NULL"))
def store_options(spark, sf_dir):
    """The stores there are."""
    return sales.store_options(views.labelled_sales(spark, sf_dir))


# --- KPIs of a date range and chosen stores ----------------------------------------


def _chosen(spark, sf_dir):
    return apply_filters(views.labelled_sales(spark, sf_dir), FIRST, LAST, STORES)


def _of_chosen(body: str) -> str:
    where = f"sale_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}' AND store IN {STORES}"
    return views.sales_oracle(body.replace("FROM labelled", f"FROM (SELECT * FROM labelled WHERE {where})"))


@_query(_of_chosen(_SHARES))
def set_shares_filtered(spark, sf_dir):
    """Rows and shares of both sets after the date and store filters."""
    return sales.set_shares(_chosen(spark, sf_dir))


@_query(_of_chosen(_BY_SET))
def sales_by_set_filtered(spark, sf_dir):
    """Sales sum of both sets after the date and store filters."""
    return sales.sales_by_set(_chosen(spark, sf_dir))


@_query(_of_chosen(f"""
SELECT store, {_total("weekly_sales")} AS weekly_sales FROM labelled WHERE "set" = 'Valid'
GROUP BY store ORDER BY weekly_sales DESC, store LIMIT 12"""))
def top_stores_filtered(spark, sf_dir):
    """The stores with the highest valid sales after the date and store filters."""
    return sales.top_stores(_chosen(spark, sf_dir).filter(F.col("set") == VALID))


@_query(_of_chosen("""
SELECT store, COUNT(*) AS n FROM labelled WHERE "set" = 'Quarantine'
GROUP BY store ORDER BY n DESC, store LIMIT 8"""))
def top_offenders_filtered(spark, sf_dir):
    """The stores with most quarantined rows after the date and store filters."""
    return sales.top_offenders(_chosen(spark, sf_dir).filter(F.col("set") == QUARANTINE))


# --- labels and zones --------------------------------------------------------------


@_query(views.oracle("""
SELECT id, weekly_sales, CASE WHEN weekly_sales >= q66 THEN 'High'
                              WHEN weekly_sales >= q33 THEN 'Medium' ELSE 'Low' END AS sales_label
FROM sales_v, (SELECT quantile_cont(weekly_sales, 0.33) AS q33,
                      quantile_cont(weekly_sales, 0.66) AS q66 FROM sales_v)""",
    sales_v=views.SALES))
def sales_label(spark, sf_dir):
    """High, Medium or Low by the quantiles of all sales."""
    return zones.sales_label(views.sales(spark, sf_dir).select("id", "weekly_sales"))


def _zone_sql(metric: str) -> str:
    return views.sales_oracle(f"""
, clean AS (SELECT "set", CAST({metric} AS DOUBLE) AS x, weekly_sales FROM labelled
            WHERE {metric} IS NOT NULL AND weekly_sales IS NOT NULL),
edges AS (SELECT "set", COUNT(*) AS n, MIN(x) AS e0, quantile_cont(x, CAST(1 AS DOUBLE) / 3) AS e1,
                 quantile_cont(x, CAST(2 AS DOUBLE) / 3) AS e2, MAX(x) AS e3,
                 quantile_cont(x, 0.33) AS f1, quantile_cont(x, 0.66) AS f2
          FROM clean GROUP BY "set"),
cuts AS (SELECT "set", CASE WHEN e0 < e1 AND e1 < e2 AND e2 < e3 THEN e1 ELSE f1 END AS c1,
                CASE WHEN e0 < e1 AND e1 < e2 AND e2 < e3 THEN e2 ELSE f2 END AS c2
         FROM edges WHERE n >= 5),
zoned AS (SELECT clean."set", weekly_sales,
                 CASE WHEN x <= c1 THEN 'Baixa' WHEN x <= c2 THEN 'Média' ELSE 'Alta' END AS zone
          FROM clean JOIN cuts ON clean."set" = cuts."set"),
means AS (SELECT zone, "set", {_mean("weekly_sales")} AS avg_sales FROM zoned GROUP BY 1, 2),
grid AS (SELECT * FROM (VALUES ('Baixa', 0), ('Média', 1), ('Alta', 2)) z(zone, zone_rank),
                       (VALUES ('Valid', 0), ('Quarantine', 1)) s("set", set_rank))
SELECT grid.zone, CAST(zone_rank AS INT) AS zone_rank, grid."set",
       CAST(set_rank AS INT) AS set_rank, avg_sales
FROM grid LEFT JOIN means ON means.zone = grid.zone AND means."set" = grid."set" """)


@_query(_zone_sql(METRIC))
def zone_effect(spark, sf_dir):
    """Mean sales in the low, middle and high third of a metric, per set."""
    return zones.zone_effect(views.labelled_sales(spark, sf_dir), METRIC)


@_query(_zone_sql("holiday_flag"))
def zone_effect_fallback(spark, sf_dir):
    """Zones of a column whose tercile edges coincide."""
    return zones.zone_effect(views.labelled_sales(spark, sf_dir), "holiday_flag")


# --- rules -------------------------------------------------------------------------


def _checks(spark, sf_dir):
    checks = views.view(spark, sf_dir, views.CHECKS, "part")
    return checks.withColumnRenamed("check_text", "check")


@_query(views.oracle("""
SELECT COUNT(*) AS rules, COUNT(*) FILTER (criticality = 'error') AS errors,
       COUNT(*) FILTER (criticality = 'warn') AS warnings FROM checks_v""", checks_v=views.CHECKS))
def catalogue_counts(spark, sf_dir):
    """Rules in total and by criticality."""
    return quality.catalogue_counts(_checks(spark, sf_dir))


@_query(views.oracle("""
SELECT name, criticality, check_text AS "check" FROM checks_v""", checks_v=views.CHECKS))
def catalogue_view(spark, sf_dir):
    """The catalogue columns that exist, as stored."""
    return quality.catalogue_view(_checks(spark, sf_dir))


@_query(views.oracle("""
SELECT name, criticality,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'is_not_null'
       WHEN p_partkey % 3 = 1 THEN 'is_in_list' ELSE 'is_in_range' END AS function,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_type
       ELSE 'p_size' END AS "column",
  CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 3 = 1
       THEN CAST(p_size AS STRING) || '|' || CAST(p_size + 1 AS STRING) END AS allowed,
  CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 3 = 2 THEN CAST(-p_size AS DOUBLE) END AS min_limit,
  CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 3 = 2 THEN p_size + CAST(0.5 AS DOUBLE) END
    AS max_limit
FROM checks_v""", checks_v=views.CHECKS))
def catalogue_parsed(spark, sf_dir):
    """The catalogue with its JSON checks as typed columns."""
    parsed = quality.parse_catalogue(_checks(spark, sf_dir))
    return parsed.withColumn("allowed", F.array_join("allowed", "|"))


_BROKEN = {  # rule name -> condition, errors first, each list in name order
    "__errors": [
        ("Fuel_Price_is_null", "fuel_price IS NULL"),
        ("Holiday_Flag_other_value", "holiday_flag NOT IN (0, 1)"),
        ("Sales_Label_is_null", "sales_label IS NULL"),
        ("Sales_Label_other_value", "sales_label NOT IN ('High', 'Medium', 'Low')"),
        ("Temperature_isnt_in_range", "temperature < -10 OR temperature > 55"),
    ],
    "__warnings": [("Temperature_is_null", "temperature IS NULL")],
}


def _names_sql(log: str) -> str:
    names = ", ".join(f"CASE WHEN {when} THEN '{name}' END" for name, when in _BROKEN[log])
    return f"CASE WHEN \"set\" = 'Quarantine' THEN concat_ws(',', {names}) END"


def _hits_sql(log: str) -> str:
    return views.sales_oracle(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{name}' AS rule, COUNT(*) AS n FROM sales_v WHERE {when}"
            for name, when in _BROKEN[log]
        )
        + ") WHERE n > 0"
    )


def _log_sql(*issues: tuple[str, str, str, str]) -> str:
    """Issue log text; the issues in catalogue order as (name, column, message, condition)."""
    items = ", ".join(
        f"""CASE WHEN {when} THEN '{{"name":"{name}","column":"{column}","message":"{text}"}}' END"""
        for name, column, text, when in issues
    )
    return f"""'{{"items":[' || concat_ws(',', {items}) || ']}}'"""


@_query(views.sales_oracle(f"""
SELECT id, "set", {_names_sql("__errors")} AS errors, {_names_sql("__warnings")} AS warnings
FROM labelled"""))
def dq_split(spark, sf_dir):
    """Every row's set and the names of the rules it breaks."""
    labelled = views.labelled_sales(spark, sf_dir, issues=True)
    named = quality.with_rule_names(labelled, {"error_issues": "errors", "warning_issues": "warnings"})
    return named.select(
        "id",
        "set",
        *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("errors", "warnings")],
    )


_ERRORS_SQL = _log_sql(
    ("Sales_Label_is_null", "sales_label", "sales_label vazio.", "sales_label IS NULL"),
    ("Sales_Label_other_value", "sales_label", "sales_label inválido.",
     "sales_label NOT IN ('High', 'Medium', 'Low')"),
    ("Fuel_Price_is_null", "fuel_price", "fuel_price vazio.", "fuel_price IS NULL"),
    ("Temperature_isnt_in_range", "temperature", "temperature fora do intervalo [-10, 55].",
     "temperature < -10 OR temperature > 55"),
    ("Holiday_Flag_other_value", "holiday_flag", "holiday_flag fora de {0,1}.",
     "holiday_flag NOT IN (0, 1)"),
)
_WARNINGS_SQL = _log_sql(
    ("Temperature_is_null", "temperature", "temperature vazio.", "temperature IS NULL")
)


@_query(views.sales_oracle(f"""
SELECT id, {_ERRORS_SQL} AS errors, {_WARNINGS_SQL} AS warnings
FROM labelled WHERE "set" = 'Quarantine'"""))
def quarantine_logs(spark, sf_dir):
    """Issue logs of the quarantined rows, as JSON text."""
    checks = quality.sales_catalogue(spark, views.LEFT_OUT_RULES)
    _, quarantine = quality.split(views.sales(spark, sf_dir), quality.read_rules(checks))
    return quarantine.select(
        "id", F.col("__errors").alias("errors"), F.col("__warnings").alias("warnings")
    )


def _weekly_checks(rows):
    """A rule catalogue out of the rows themselves: for every week its stores and its largest sale.

    The calendar bounds it: two rules a week.
    """
    weeks = rows.groupBy("sale_date").agg(
        F.max("weekly_sales").alias("top"), F.sort_array(F.collect_set("store")).alias("stores")
    )
    text = F.date_format("sale_date", "yyyy-MM-dd")

    def check(function, **arguments):
        made = F.struct(*[value.alias(name) for name, value in arguments.items()])
        return F.to_json(F.struct(F.lit(function).alias("function"), made.alias("arguments")))

    top = check("is_in_range", column=F.lit("weekly_sales"), max_limit=F.col("top"))
    stores = check("is_in_list", column=F.lit("store"), allowed=F.col("stores"))
    rules = weeks.select(F.explode(F.array(
        F.struct(F.concat(F.lit("top_"), text).alias("name"), F.lit("error").alias("criticality"), top.alias("check")),
        F.struct(F.concat(F.lit("stores_"), text).alias("name"), F.lit("warn").alias("criticality"), stores.alias("check")),
    )).alias("rule"))
    return rules.select("rule.*")


@_query(views.oracle("""
SELECT 'top_' || strftime(w.sale_date, '%Y-%m-%d') AS rule, COUNT(*) AS n
FROM sales_v s JOIN (SELECT sale_date, MAX(weekly_sales) AS top FROM sales_v GROUP BY sale_date) w
  ON s.weekly_sales > w.top GROUP BY w.sale_date
UNION ALL
SELECT 'stores_' || strftime(w.sale_date, '%Y-%m-%d'), SUM(c.n)::BIGINT
FROM (SELECT DISTINCT sale_date FROM sales_v) w,
     (SELECT store, COUNT(*) AS n FROM sales_v GROUP BY store) c
WHERE NOT EXISTS (SELECT 1 FROM sales_v o WHERE o.sale_date = w.sale_date AND o.store = c.store)
GROUP BY w.sale_date""", sales_v=views.SALES))
def rule_hits_large_catalogue(spark, sf_dir):
    """How often each of two rules a week is broken, the catalogue being a table made of the rows."""
    rows = views.sales(spark, sf_dir)
    labelled = label_sets_from(rows, _weekly_checks(rows), issues=True)
    names = labelled.select(F.concat("error_issues", "warning_issues").alias("issues"))
    return quality.rule_hits(names, "issues")


# Two configurations of one catalogue, one of them with rules that hold for some rows only.
_CONFIGURED_RULES = [
    ("label_known", "error", '{"function": "is_in_list", "arguments": {"column": "sales_label", "allowed": ["High", "Medium", "Low"]}}', None, "nightly"),
    ("warm_in_december", "warn", '{"function": "is_in_range", "arguments": {"column": "temperature", "max_limit": 40}}', "holiday_flag = 1", "nightly"),
    ("fuel_of_small_stores", "error", '{"function": "is_not_null", "arguments": {"column": "fuel_price"}}', "store <= 10", "nightly"),
    ("cpi_low", "error", '{"function": "is_in_range", "arguments": {"column": "cpi", "max_limit": 205}}', None, "weekly"),
]
_NIGHTLY = """COALESCE(sales_label NOT IN ('High', 'Medium', 'Low'), FALSE)
  OR COALESCE(holiday_flag = 1 AND temperature > 40, FALSE) OR (store <= 10 AND fuel_price IS NULL)"""


@_query(views.oracle(f"""
SELECT "set", COUNT(*) AS n, {_total("weekly_sales")} AS sales
FROM (SELECT *, CASE WHEN {_NIGHTLY} THEN 'Quarantine' ELSE 'Valid' END AS "set" FROM sales_v)
GROUP BY 1""", sales_v=views.SALES))
def sales_by_set_configured(spark, sf_dir):
    """Rows and sales of both sets by the rules of one configuration, some of them with a filter."""
    checks = spark.createDataFrame(_CONFIGURED_RULES, quality.CATALOGUE_SCHEMA)
    rules = quality.read_rules(checks.filter(F.col("run_config_name") == "nightly"))
    labelled = quality.label_sets(views.sales(spark, sf_dir), rules)
    return labelled.groupBy("set").agg(F.count("*").alias("n"), exact_sum("weekly_sales").alias("sales"))


@_query(_hits_sql("__errors"))
def rule_hits_errors(spark, sf_dir):
    """How often each error rule is broken, counted from the issues the logs are made of."""
    labelled = views.labelled_sales(spark, sf_dir, issues=True)
    return quality.rule_hits(labelled, "error_issues")


@_query(_hits_sql("__warnings"))
def rule_hits_warnings(spark, sf_dir):
    """How often each warning rule is broken, counted from the logs."""
    return quality.rule_hits(_quarantined(spark, sf_dir), "__warnings")


@_query(views.oracle("""
SELECT rule, COUNT(*) AS n FROM (
  SELECT o_orderpriority AS rule FROM orders WHERE o_orderkey % 11 IN (0, 1)
  UNION ALL SELECT o_orderstatus FROM orders WHERE o_orderkey % 11 IN (0, 8, 9)
  UNION ALL SELECT 'unknown' FROM orders WHERE o_orderkey % 11 = 2)
GROUP BY rule""", logs_v=views.LOGS))
def rule_hits_dirty_logs(spark, sf_dir):
    """Rule counts from logs some of which are malformed or incomplete."""
    return quality.rule_hits(views.view(spark, sf_dir, views.LOGS, "orders"), "log")


@_query(views.sales_oracle(f"""
SELECT id, store, sale_date, weekly_sales, holiday_flag, temperature, fuel_price, cpi,
       unemployment, sales_label, {_ERRORS_SQL} AS "__errors", {_WARNINGS_SQL} AS "__warnings"
FROM labelled WHERE "set" = 'Quarantine' ORDER BY id, sale_date, store LIMIT 80"""))
def quarantine_examples(spark, sf_dir):
    """The first 80 quarantined rows, with the logs of what is wrong with them."""
    return quality.quarantine_examples(_quarantined(spark, sf_dir))


# --- texts -------------------------------------------------------------------------


def _dotted_sql(x: str) -> str:
    return f"translate(format('{{:,}}', {x}), ',', '.')"


@_query(views.sales_oracle(f"""
SELECT {_dotted_sql("total_rows")} AS total_rows, format('{{:.1f}}', valid_pct) || '%' AS valid_pct,
       {_dotted_sql("valid_rows")} AS valid_rows,
       format('{{:.1f}}', quarantine_pct) || '%' AS quarantine_pct,
       {_dotted_sql("quarantine_rows")} AS quarantine_rows,
       '$' || format('{{:.2f}}', valid_sales / 1e9) || 'B' AS valid_sales,
       '$' || format('{{:.2f}}', quarantine_sales / 1e9) || 'B' AS quarantine_sales
FROM ({_SHARES}), ({_BY_SET})"""))
def kpi_text_sets(spark, sf_dir):
    """Rows, shares and sales of both sets as text, from one scan."""
    return sales.set_kpis(views.labelled_sales(spark, sf_dir)).select(
        dotted_text(F.col("total_rows")).alias("total_rows"),
        percent_text(F.col("valid_pct")).alias("valid_pct"),
        dotted_text(F.col("valid_rows")).alias("valid_rows"),
        percent_text(F.col("quarantine_pct")).alias("quarantine_pct"),
        dotted_text(F.col("quarantine_rows")).alias("quarantine_rows"),
        billions_text(F.col("valid_sales")).alias("valid_sales"),
        billions_text(F.col("quarantine_sales")).alias("quarantine_sales"),
    )


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(p, '{w}')" for w in words) + ")"


@_query(views.oracle(f"""
SELECT conv_id, turn, text, intent,
  CASE WHEN intent = 'rank' THEN COALESCE(metric, 'trips') ELSE metric END AS metric,
  CASE WHEN intent = 'rank' THEN CAST(CASE WHEN contains(p, '5') THEN 5 ELSE 1 END AS INT) END AS n,
  CASE WHEN intent = 'rank' THEN {_has("pior", "piores", "menor")} END AS ascending
FROM (SELECT *,
  CASE WHEN {_has("ajuda", "help", "exemplos")} THEN 'help'
       WHEN {_has("melhor dia", "pior dia", "top", "melhores", "maiores", "pior", "menor")}
       THEN 'rank'
       WHEN {_has("total")} AND {_has("ano")} THEN 'year_total'
       WHEN {_has("média")} AND {_has("ano", "por dia")} THEN 'daily_avg'
       WHEN {_has("resumo")} AND {_has("mês", "mes")} THEN 'month_summary'
       WHEN {_has("compar", "mês anterior", "mes anterior")} THEN 'compare'
       ELSE 'unknown' END AS intent,
  CASE WHEN {_has("viagem")} THEN 'trips'
       WHEN {_has("€", "euro", "dinheiro", "ganho", "receita")} THEN 'revenue'
       WHEN {_has("km", "quil", "kil")} THEN 'km' END AS metric
  FROM (SELECT *, lower(trim(text)) AS p FROM prompts_v))""", prompts_v=views.PROMPTS))
def question_tags(spark, sf_dir):
    """What each message asks for."""
    return questions.tag_questions(views.view(spark, sf_dir, views.PROMPTS, "conversations"))
