"""Messy inputs derived from the driver tables.

Each derivation is one SQL text in the common subset of Spark SQL and the
oracle's SQL; only date formatting differs, written ``{{format}}``.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.session import prepare

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Java pattern letters and their strftime counterparts.
STRFTIME = {"yyyy": "%Y", "yy": "%y", "MM": "%m", "M": "%-m", "dd": "%d", "d": "%-d"}

_FORMAT = re.compile(r"\{\{([^}]+)\}\}")


def for_spark(sql: str, column: str = "o_orderdate") -> str:
    return _FORMAT.sub(lambda m: f"date_format({column}, '{m.group(1)}')", sql)


def for_oracle(sql: str, column: str = "o_orderdate") -> str:
    def convert(m: re.Match) -> str:
        pattern = re.sub("y+|M+|d+", lambda p: STRFTIME[p.group(0)], m.group(1))
        return f"strftime({column}, '{pattern}')"

    return _FORMAT.sub(convert, sql)


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    prepare(spark)
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark side of a derivation: registers just the tables it names."""
    load(spark, sf_dir, *[t for t in TABLES if re.search(rf"\b{t}\b", sql)])
    return spark.sql(for_spark(sql))


# Month names by number, for the derivations.
MONTH_NAME = "CASE month(o_orderdate) " + " ".join(
    f"WHEN {n} THEN '{name}'"
    for n, name in enumerate(
        "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split(), 1
    )
) + " END"

MONTH_ABBREV = "substr('janfevmarabrmaijunjulagosetoutnovdez', month(o_orderdate) * 3 - 2, 3)"

MESSY_ORDERS = """
SELECT o_orderkey AS k,
  CASE o_orderkey % 7 WHEN 0 THEN {{dd/MM/yyyy}} WHEN 1 THEN {{yyyy-MM-dd}} WHEN 2 THEN {{dd-MM-yy}}
    WHEN 3 THEN {{yyyy/MM/dd}} WHEN 4 THEN 's/ data' WHEN 5 THEN '31/02/' || cast(2000 + o_orderkey % 9 AS varchar(4))
    ELSE {{dd.MM.yyyy}} END AS data_pedido,
  {{dd/MM/yyyy}} || ' 14:' || lpad(cast(o_orderkey % 60 AS varchar(10)), 2, '0') AS registro,
  substr(n, 1, 3) || '.' || substr(n, 4, 3) || '.' || substr(n, 7, 3) || '-' || substr(n, 10, 2) AS cpf,
  substr(n, 1, 5) || '-' || substr(n, 6, 3) AS cep,
  '(11) 9' || substr(n, 1, 4) || '-' || substr(n, 5, 4) AS telefone,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE cast(o_custkey AS varchar(20)) END AS codigo,
  cast(cast(o_totalprice AS decimal(18, 2)) AS varchar(30)) AS valor,
  cast(o_custkey AS varchar(20)) AS cliente,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS prioridade
FROM (SELECT *, lpad(cast(o_custkey * 7919 + 12345 AS varchar(20)), 11, '0') AS n FROM orders) x
"""

# What the columns of MESSY_ORDERS must become, worked out from the order itself.
CLEAN_ORDERS = """
SELECT o_orderkey AS k,
  CASE o_orderkey % 7 WHEN 2 THEN make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate))
    WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE cast(o_orderdate AS date) END AS data_pedido,
  cast(o_orderdate AS timestamp) + INTERVAL 14 HOUR + to_minutes(o_orderkey % 60) AS registro,
  n AS cpf, substr(n, 1, 8) AS cep, '55119' || substr(n, 1, 8) AS telefone,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE cast(o_custkey AS varchar) END AS codigo,
  o_totalprice AS valor, o_custkey AS cliente,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS prioridade
FROM (SELECT *, lpad(cast(o_custkey * 7919 + 12345 AS varchar), 11, '0') AS n FROM orders) x
"""

MESSY_COLUMNS = "data_pedido registro cpf cep telefone codigo valor cliente prioridade".split()


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, MESSY_ORDERS)


ORACLE_MESSY = for_oracle(MESSY_ORDERS)

# Worksheet cells from orders: one sheet per status, the order key gives the row.
SHEET_ROWS = """
SELECT 'sheet ' || o_orderstatus AS sheet, o_orderkey + 2 AS r,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(cast(o_totalprice AS decimal(18, 2)) AS varchar(30)) END AS c1,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(o_custkey AS varchar(20)) END AS c2,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS c3,
  CASE o_orderkey % 6 WHEN 0 THEN '=AVERAGE(A' || cast(o_orderkey + 2 AS varchar(20)) || ':B' || cast(o_orderkey + 2 AS varchar(20)) || ')'
    WHEN 1 THEN '=A' || cast(o_orderkey + 2 AS varchar(20)) || '*(B' || cast(o_orderkey + 2 AS varchar(20)) || '+2)'
    WHEN 2 THEN '=SUM($A' || cast(o_orderkey + 2 AS varchar(20)) || ':B2)'
    WHEN 3 THEN '=SUM(A2:A' || cast(o_orderkey + 2 AS varchar(20)) || ')'
    WHEN 4 THEN '=SUM(A2:A999999999999)'
    ELSE '=SUM(A' || cast(o_orderkey + 2 AS varchar(20)) || ':C' || cast(o_orderkey + 2 AS varchar(20)) || ')' END AS c4
FROM orders
"""

SHEET_CELLS = f"""
WITH g AS ({SHEET_ROWS})
SELECT sheet, r AS row, 1 AS col, c1 AS value, 'float' AS value_type, false AS is_formula FROM g
UNION ALL SELECT sheet, r, 2, c2, 'int', false FROM g
UNION ALL SELECT sheet, r, 3, c3, 'str', false FROM g
UNION ALL SELECT sheet, r, 4, c4, 'str', true FROM g
UNION ALL SELECT DISTINCT sheet, cast(1 AS bigint), 1, 'Price', 'str', false FROM g
UNION ALL SELECT DISTINCT sheet, cast(1 AS bigint), 2, 'Customer', 'str', false FROM g
UNION ALL SELECT DISTINCT sheet, cast(1 AS bigint), 3, 'Priority', 'str', false FROM g
UNION ALL SELECT DISTINCT sheet, cast(1 AS bigint), 4, 'Total', 'str', false FROM g
UNION ALL SELECT 'header only ' || r_name, cast(1 AS bigint), 1, r_name, 'str', false FROM region
UNION ALL SELECT 'formula only ' || n_name, cast(3 AS bigint), 1, 'Total', 'str', false FROM nation
UNION ALL SELECT 'formula only ' || n_name, cast(4 AS bigint), 1, '=SUM(A' || cast(n_nationkey AS varchar(9)) || ':B2)', 'str', true FROM nation
UNION ALL SELECT 'blank ' || r_name, cast(7 AS bigint), 2, '', 'str', false FROM region
"""


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, SHEET_CELLS)
