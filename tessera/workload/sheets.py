"""Worksheets and spreadsheet formulas."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import formula as X
from tessera.operators import formulas, worksheet
from tessera.operators.formula_values import formula_values
from tessera.operators.cells import ROW
from tessera.workload.inputs import SHEET_CELLS, SHEET_ROWS, for_oracle, run, sheet_cells
from tessera.workload.registry import query

CELLS = f"WITH cells AS ({for_oracle(SHEET_CELLS)}), g AS ({for_oracle(SHEET_ROWS)})"
KEPT = "FROM g WHERE c1 IS NOT NULL"


@query(
    "cells_to_dataset",
    f"""{CELLS} SELECT sheet AS dataset, r AS row, 'Price' AS "column", c1 AS text, 'float' AS tag {KEPT}
    UNION ALL SELECT sheet, r, 'Customer', c2, 'int' {KEPT}
    UNION ALL SELECT sheet, r, 'Priority', nullif(c3, ''), CASE WHEN c3 = '' THEN 'null' ELSE 'str' END {KEPT}""",
)
def to_dataset(spark, sf_dir):
    found = worksheet.to_cells(sheet_cells(spark, sf_dir))
    return found.select("dataset", F.col(ROW).alias("row"), "column", "text", "tag")


@query(
    "cells_formula_columns",
    f"""{CELLS} SELECT sheet, col FROM cells JOIN (SELECT sheet, min(row) AS h FROM cells WHERE value <> '' GROUP BY sheet) x USING (sheet)
    WHERE row > h AND is_formula AND value <> '' GROUP BY ALL""",
)
def formula_columns(spark, sf_dir):
    return worksheet.formula_columns(worksheet.layout(sheet_cells(spark, sf_dir)))


@query(
    "cells_drop_formula_only_rows",
    f"""{CELLS} SELECT sheet, r AS row FROM g WHERE c1 IS NULL
    UNION ALL SELECT DISTINCT sheet, row FROM cells WHERE sheet LIKE 'formula only%' AND row = 4""",
)
def formula_only(spark, sf_dir):
    cells = sheet_cells(spark, sf_dir)
    return worksheet.dropped_rows(cells, worksheet.layout(cells))


@query(
    "cells_numeric_inputs",
    f"""{CELLS} SELECT DISTINCT sheet, t.col, t.col < 3 AS numeric FROM g
    CROSS JOIN (VALUES (1), (2), (3)) t(col)""",
)
def numeric_inputs(spark, sf_dir):
    return worksheet.numeric_columns(worksheet.layout(sheet_cells(spark, sf_dir)))


@query(
    "formula_inventory",
    f"""{CELLS} SELECT sheet, 4 AS col, 'Total' AS "column", c4 AS formula, count(*) AS n_cells FROM g GROUP BY ALL""",
)
def inventory(spark, sf_dir):
    return formulas.formula_inventory(sheet_cells(spark, sf_dir))


@query(
    "formula_inputs",
    f"""{CELLS}, kinds AS (SELECT DISTINCT sheet, c4, cast(r - 2 AS bigint) % 6 AS shape FROM g),
    used AS (SELECT sheet, c4, unnest(CASE WHEN shape = 5 THEN ['Price', 'Customer', 'Priority']
      WHEN shape IN (3, 4) THEN ['Price'] ELSE ['Price', 'Customer'] END) AS input FROM kinds)
    SELECT sheet, 4 AS col, c4 AS formula, input,
      row_number() OVER (PARTITION BY sheet, c4 ORDER BY CASE input WHEN 'Price' THEN 1 WHEN 'Customer' THEN 2 ELSE 3 END) AS place
    FROM used""",
)
def inputs(spark, sf_dir):
    from pyspark.sql import Window as W

    found = formulas.formula_inputs(sheet_cells(spark, sf_dir))
    # A formula names a handful of inputs, so this window stays small.
    place = F.row_number().over(W.partitionBy("sheet", "col", "formula").orderBy("first_use"))
    return found.select("sheet", "col", "formula", "input", place.cast("bigint").alias("place"))


@query(
    "formula_eligibility",
    f"""{CELLS}, spread AS (SELECT sheet, max(r) AS last_row FROM g WHERE c1 IS NOT NULL GROUP BY sheet)
    SELECT sheet, r AS row, c4 AS formula,
      CASE cast(r - 2 AS bigint) % 6 WHEN 0 THEN 'horizontal' WHEN 1 THEN 'arithmetic'
        WHEN 3 THEN CASE WHEN r >= last_row AND r > 2 THEN 'vertical' END WHEN 4 THEN 'vertical' END AS shape,
      CASE cast(r - 2 AS bigint) % 6 WHEN 2 THEN 'absolute reference' WHEN 5 THEN 'input not numeric'
        WHEN 3 THEN CASE WHEN r >= last_row AND r > 2 THEN 'derivable' ELSE 'rows not covered' END ELSE 'derivable' END AS verdict
    FROM g JOIN spread USING (sheet)""",
)
def eligibility(spark, sf_dir):
    return formulas.formula_eligibility(sheet_cells(spark, sf_dir)).select("sheet", "row", "formula", "shape", "verdict")


# Cells as text: one in seven prices is not a number, one in nine taxes is missing.
TEXT_CELLS = """
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity,
  CASE WHEN l_partkey % 7 = 0 THEN 'n/a' ELSE cast(cast(l_extendedprice AS decimal(18, 2)) AS varchar(30)) END AS a,
  cast(cast(l_quantity AS decimal(18, 2)) AS varchar(30)) AS b,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE cast(cast(l_tax AS decimal(18, 2)) AS varchar(30)) END AS c
FROM lineitem
"""
NUMBERS = f"SELECT *, try_cast(a AS double) AS x, try_cast(b AS double) AS y, try_cast(c AS double) AS z FROM ({TEXT_CELLS}) t"
IDS = "l_orderkey, l_linenumber, l_suppkey, l_quantity"


def cell_columns():
    return F.col("a"), F.col("b"), F.col("c")


def row_formula(name: str, sql: str, value, digits: int = 6) -> None:
    @query(name, f"SELECT {IDS}, round({sql}, {digits}) AS value FROM ({NUMBERS}) n")
    def evaluated(spark, sf_dir):
        keys = [key.strip() for key in IDS.split(",")]
        return run(spark, sf_dir, TEXT_CELLS).select(
            *keys, F.round(value(*cell_columns()), digits).alias("value")
        )


_LIST = "list_filter([x, y, z], lambda v: v IS NOT NULL)"
row_formula("row_sum", "coalesce(x, 0) + coalesce(y, 0) + coalesce(z, 0)", X.row_sum)
row_formula("row_average", f"list_avg({_LIST})", X.row_average, 4)
row_formula("row_stddev_samp", f"list_stddev_samp({_LIST})", X.row_stddev, 4)
row_formula("row_stddev_pop", f"list_stddev_pop({_LIST})", lambda a, b, c: X.row_stddev(a, b, c, pop=True), 4)
row_formula(
    "row_arithmetic",
    "-(coalesce(x, 0) + 2.5e0) * coalesce(y, 0) / nullif(coalesce(z, 0), 0)",
    lambda a, b, c: X.divide(-(X.operand(a) + F.lit(2.5)) * X.operand(b), X.operand(c)),
    2,
)


def grouped(name: str, sql: str, aggregate, digits: int = 4) -> None:
    """One value per supplier, over all its lines."""

    @query(name, f"SELECT l_suppkey, round({sql}, {digits}) AS value FROM ({NUMBERS}) n GROUP BY l_suppkey")
    def evaluated(spark, sf_dir):
        return run(spark, sf_dir, TEXT_CELLS).groupBy("l_suppkey").agg(F.round(aggregate(*cell_columns()), digits).alias("value"))


grouped("column_sum", "coalesce(sum(z), 0)", lambda a, b, c: X.column_sum(c), 2)
grouped("column_average", "avg(x)", lambda a, b, c: X.column_average(a), 2)
grouped("column_stddev_samp", "stddev_samp(x)", lambda a, b, c: X.column_stddev(a))
grouped("column_stddev_pop", "stddev_pop(z)", lambda a, b, c: X.column_stddev(c, pop=True))
grouped("block_sum", "coalesce(sum(x), 0) + coalesce(sum(y), 0)", lambda a, b, c: X.block_sum(a, b), 2)
grouped(
    "block_average",
    "(coalesce(sum(x), 0) + coalesce(sum(y), 0)) / nullif(count(x) + count(y), 0)",
    lambda a, b, c: X.block_average(a, b),
    2,
)


def block(name: str, function: str, pop: bool) -> None:
    stacked = f"SELECT l_suppkey, x AS v FROM ({NUMBERS}) n UNION ALL SELECT l_suppkey, y FROM ({NUMBERS}) n"

    @query(name, f"SELECT l_suppkey, round({function}(v), 4) AS value FROM ({stacked}) s GROUP BY l_suppkey")
    def evaluated(spark, sf_dir):
        spread = X.block_stddev(run(spark, sf_dir, TEXT_CELLS), ["a", "b"], ["l_suppkey"], pop)
        return spread.select("l_suppkey", F.round("stddev", 4).alias("value"))


block("block_stddev_samp", "stddev_samp", False)
block("block_stddev_pop", "stddev_pop", True)


_R = "cast(o_orderkey + 2 AS varchar(20))"
#: A sheet for each customer, with prices, counts and one of six formulas in every row.
BOOKS = f"""
WITH g AS (SELECT 'c ' || cast(o_custkey AS varchar(20)) AS sheet, o_orderkey + 2 AS r, o_orderkey AS k, cast(cast(o_totalprice AS decimal(18, 2)) AS varchar(30)) AS a FROM orders)
SELECT sheet, r AS row, 1 AS col, a AS value, 'float' AS value_type, false AS is_formula FROM g
UNION ALL SELECT sheet, r, 2, cast(k % 7 AS varchar(9)), 'int', false FROM g
UNION ALL SELECT sheet, r, 3, CASE k % 6 WHEN 0 THEN '=A' || cast(r AS varchar(20)) || '*(B' || cast(r AS varchar(20)) || '+2)-A' || cast(r AS varchar(20)) || '/B' || cast(r AS varchar(20))
    WHEN 1 THEN '=AVERAGE(A' || cast(r AS varchar(20)) || ':B' || cast(r AS varchar(20)) || ')' WHEN 2 THEN '=STDEV(A2:B99999999)' WHEN 3 THEN '=SUM(A2:A99999999)'
    WHEN 4 THEN '=STDEV.P(A' || cast(r AS varchar(20)) || ',B' || cast(r AS varchar(20)) || ')' ELSE '=-A' || cast(r AS varchar(20)) || '*2+(B' || cast(r AS varchar(20)) || '-1)*3' END, 'str', true FROM g
UNION ALL SELECT DISTINCT sheet, cast(1 AS bigint), 1, 'Price', 'str', false FROM g
UNION ALL SELECT DISTINCT sheet, cast(1 AS bigint), 2, 'Count', 'str', false FROM g
UNION ALL SELECT DISTINCT sheet, cast(1 AS bigint), 3, 'Out', 'str', false FROM g
"""


@query(
    "formula_values",
    """WITH g AS (SELECT 'c ' || o_custkey AS sheet, o_orderkey + 2 AS row, o_orderkey % 6 AS f, cast(cast(o_totalprice AS decimal(18, 2)) AS double) AS a, cast(o_orderkey % 7 AS double) AS b FROM orders),
    whole AS (SELECT sheet, stddev_samp(x) AS spread FROM (SELECT sheet, a AS x FROM g UNION ALL SELECT sheet, b FROM g) u GROUP BY sheet)
    SELECT sheet, row, CASE f WHEN 0 THEN 'arithmetic' WHEN 5 THEN 'arithmetic' WHEN 2 THEN 'vertical' WHEN 3 THEN 'vertical' ELSE 'horizontal' END AS shape,
      round(CASE f WHEN 0 THEN a * (b + 2) - a / nullif(b, 0) WHEN 1 THEN (a + b) / 2 WHEN 2 THEN spread WHEN 3 THEN sum(a) OVER (PARTITION BY sheet)
        WHEN 4 THEN abs(a - b) / 2 ELSE -a * 2 + (b - 1) * 3 END, 3) AS value FROM g JOIN whole USING (sheet)""",
)
def values(spark, sf_dir):
    """Formulas of all rows of a sheet per customer, in one job."""
    return formula_values(run(spark, sf_dir, BOOKS)).select("sheet", "row", "shape", F.round("value", 3).alias("value"))
