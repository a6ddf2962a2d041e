"""The library's tables as views over the test tables, for Spark and for the oracle.

Each text is plain SQL that both engines run unchanged: ``{name}`` stands for a table,
and literal braces are doubled. Dirt (missing values, bad dates, broken logs) is put
in by rule on the row's key, so every view grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.operators.quality import label_sets, sales_rules
from tallyhouse.sources.tables import query

TRIPS = """
SELECT l_shipdate AS trip_date,
       l_extendedprice AS fare_eur,
       l_quantity AS distance_km,
       l_suppkey AS pickup_zip,
       l_linenumber AS dropoff_zip
FROM {lineitem}
"""

TRIPS_WITH_GAPS = """
SELECT l_shipdate AS trip_date,
       CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE l_extendedprice END AS fare_eur,
       l_quantity AS distance_km
FROM {lineitem}
"""

TAXI = """
SELECT l_quantity AS trip_distance,
       l_extendedprice AS fare_amount,
       l_suppkey AS pickup_zip,
       l_linenumber AS dropoff_zip
FROM {lineitem}
"""

SALES = """
SELECT o_orderkey AS id,
  CAST(o_custkey % 45 + 1 AS INT) AS store,
  CAST(date_trunc('week', o_orderdate) AS DATE) AS sale_date,
  o_totalprice AS weekly_sales,
  CASE WHEN o_orderkey % 97 = 0 THEN 2
       WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END AS holiday_flag,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL
       WHEN o_orderkey % 29 = 0 THEN CAST(80 AS DOUBLE)
       ELSE CAST(o_orderkey % 60 AS DOUBLE) - CAST(5 AS DOUBLE) END AS temperature,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL
       ELSE CAST(2 AS DOUBLE) + CAST(o_custkey % 100 AS DOUBLE) / 50 END AS fuel_price,
  CAST(200 AS DOUBLE) + CAST(o_orderkey % 31 AS DOUBLE) AS cpi,
  CAST(5.5 AS DOUBLE) + CAST(o_custkey % 50 AS DOUBLE) / 10 AS unemployment,
  CASE WHEN o_orderkey % 83 = 0 THEN NULL
       WHEN o_orderkey % 71 = 0 THEN 'Unknown'
       WHEN o_totalprice >= 331000 THEN 'High'
       WHEN o_totalprice >= 165000 THEN 'Medium' ELSE 'Low' END AS sales_label
FROM {orders}
"""

RAW_SALES = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 50 = 0 THEN 'not a date'
       WHEN o_orderkey % 47 = 0 THEN ''
       WHEN o_orderkey % 43 = 0 THEN '1997-02-30'
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS sale_date,
  CASE WHEN o_orderkey % 53 = 0 THEN CAST('NaN' AS DOUBLE)
       ELSE CAST(o_orderkey % 60 AS DOUBLE) END AS temperature
FROM {orders}
"""

TEXT_SALES = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 31 = 0 THEN 'n/a'
       WHEN o_orderkey % 97 = 0 THEN '1e12'
       WHEN o_orderkey % 101 = 0 THEN 'Infinity'
       WHEN o_orderkey % 103 = 0 THEN '5d'
       WHEN o_orderkey % 107 = 0 THEN '3.5'
       ELSE CAST(o_custkey % 45 + 1 AS STRING) END AS store,
  CASE WHEN o_orderkey % 37 = 0 THEN 'unknown'
       WHEN o_orderkey % 67 = 0 THEN '7d'
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS weekly_sales,
  CASE WHEN o_orderkey % 41 = 0 THEN 'yes'
       WHEN o_orderkey % 59 = 0 THEN '1d'
       WHEN o_orderkey % 61 = 0 THEN '0f'
       WHEN o_orderkey % 43 = 0 THEN '-1'
       WHEN month(o_orderdate) = 12 THEN '1' ELSE '0' END AS holiday_flag,
  CASE WHEN o_orderkey % 10 = 0 THEN 'Quarantine' ELSE 'Valid' END AS data_set
FROM {orders}
"""

CHECKS = """
SELECT concat('part_', CAST(p_partkey AS STRING)) AS name,
  CASE WHEN p_partkey % 5 = 0 THEN 'warn'
       WHEN p_partkey % 11 = 0 THEN NULL ELSE 'error' END AS criticality,
  CASE WHEN p_partkey % 13 = 0 THEN 'no json'
       WHEN p_partkey % 3 = 0
       THEN concat('{{"function": "is_not_null", "arguments": {{"column": "', p_type, '"}}}}')
       WHEN p_partkey % 3 = 1
       THEN concat('{{"function": "is_in_list", "arguments": {{"column": "p_size", "allowed": [',
                   CAST(p_size AS STRING), ', ', CAST(p_size + 1 AS STRING), ']}}}}')
       ELSE concat('{{"function": "is_in_range", "arguments": {{"column": "p_size", "min_limit": -',
                   CAST(p_size AS STRING), ', "max_limit": ', CAST(p_size AS STRING), '.5}}}}')
       END AS check_text,
  p_partkey, p_type, p_size
FROM {part}
"""

PROMPTS = """
SELECT conv_id, turn,
  concat(coalesce(text, ''), ' ', CASE conv_id % 10
    WHEN 0 THEN 'ajuda'
    WHEN 1 THEN 'melhor dia do ano em viagens'
    WHEN 2 THEN 'pior dia do ano em € ganho'
    WHEN 3 THEN '  TOP 5 dias por km '
    WHEN 4 THEN 'total do ano'
    WHEN 5 THEN 'Média por dia'
    WHEN 6 THEN 'resumo do mês'
    WHEN 7 THEN 'comparar com o mês anterior'
    WHEN 8 THEN 'menor receita'
    ELSE '' END) AS text
FROM {conversations}
"""

LOGS = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 11
    WHEN 0 THEN concat('{{"items":[{{"name":"', o_orderpriority, '"}},{{"name":"',
                       o_orderstatus, '"}}]}}')
    WHEN 1 THEN concat('{{"items": [{{"name": "', o_orderpriority, '", "column": "c"}}]}}')
    WHEN 2 THEN '{{"items":[{{"column":"c"}}]}}'
    WHEN 3 THEN '{{"items":[]}}'
    WHEN 4 THEN '{{"items":null}}'
    WHEN 5 THEN '{{}}'
    WHEN 6 THEN '[1,2]'
    WHEN 7 THEN concat('garbage ', o_orderpriority)
    WHEN 8 THEN concat('{{"items":[{{"name":"', o_orderstatus, '"}},7,{{"name":"', o_orderpriority,
                       '"}}]}}')
    WHEN 9 THEN concat('{{"items":[{{"name":"', o_orderstatus, '"}},null,{{"name":"',
                       o_orderpriority, '"}}]}}')
    ELSE CASE o_orderkey % 4
      WHEN 0 THEN replace(concat('{{"items":[{{"name":"', o_orderstatus, '"}}]}}'), '"', chr(39))
      WHEN 1 THEN concat('{{"items":[{{"name":"', o_orderstatus, '"}}]}} xyz')
      WHEN 2 THEN concat('{{"items":[{{"name":"', o_orderstatus, '"}}]}},{{}}')
      ELSE CASE o_orderkey % 5
        WHEN 0 THEN concat('{{"items":[{{"name":"', o_orderstatus, '"}}]}}] trailing')
        WHEN 1 THEN concat('{{"items":[{{"name":"', o_orderstatus, '"}}]}}]')
        WHEN 2 THEN concat('{{"items":[{{"name":"', o_orderstatus, '"}}]')
        WHEN 3 THEN concat('{{"items":[{{"name":"', o_orderstatus, '"}}]}},') END END END AS log
FROM {orders}
"""

# The id range of the standard catalogue fits a table of 6,435 rows only.
LEFT_OUT_RULES = ("id_isnt_in_range",)

_QUARANTINED = """sales_label IS NULL OR sales_label NOT IN ('High', 'Medium', 'Low')
  OR holiday_flag IS NULL OR holiday_flag NOT IN (0, 1)
  OR fuel_price IS NULL OR temperature IS NULL OR temperature < -10 OR temperature > 55
  OR unemployment IS NULL OR id IS NULL OR store IS NULL OR store < 1 OR store > 45
  OR sale_date IS NULL OR weekly_sales IS NULL OR cpi IS NULL"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str, base: str) -> DataFrame:
    """A view text as a DataFrame over its base table."""
    return query(spark, text, **{base: table(spark, sf_dir, base)})


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRIPS, "lineitem")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SALES, "orders")


def labelled_sales(spark: SparkSession, sf_dir: str, issues: bool = False) -> DataFrame:
    """Sales with ``set``, ``__errors`` and ``__warnings``, and the issues as arrays."""
    return label_sets(sales(spark, sf_dir), sales_rules(LEFT_OUT_RULES), issues)


def oracle(body: str, **views: str) -> str:
    """Oracle text: the named views as CTEs before a query body."""
    tables = {n: n for n in ("lineitem", "orders", "part", "conversations")}
    ctes = [f"{name} AS ({text.format(**tables).strip()})" for name, text in views.items()]
    return f"WITH {', '.join(ctes)} {body.strip()}"


def sales_oracle(body: str) -> str:
    """Oracle text over ``sales_v`` and ``labelled`` (with its ``"set"`` column)."""
    labelled = (
        f"SELECT *, CASE WHEN {_QUARANTINED} THEN 'Quarantine' ELSE 'Valid' END AS \"set\" "
        "FROM sales_v"
    )
    return oracle(body, sales_v=SALES, labelled=labelled)
