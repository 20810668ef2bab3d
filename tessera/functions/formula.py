"""Spreadsheet arithmetic evaluated at query time.

Cells that are not numbers count as missing: a sum takes them as 0, an average
leaves them out, a deviation without enough values is NULL.
"""
from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(cell: Column) -> Column:
    return cell.try_cast("double")


def operand(cell: Column) -> Column:
    """A cell inside arithmetic: missing counts as 0."""
    return F.coalesce(number(cell), F.lit(0.0))


def divide(left: Column, right: Column) -> Column:
    """Division by zero has no value."""
    return left / F.nullif(right, F.lit(0.0))


def _count(cells: tuple[Column, ...]) -> Column:
    return reduce(add, [number(cell).isNotNull().cast("int") for cell in cells])


def row_sum(*cells: Column) -> Column:
    return reduce(add, [operand(cell) for cell in cells])


def row_average(*cells: Column) -> Column:
    return row_sum(*cells) / F.nullif(_count(cells), F.lit(0))


def row_stddev(*cells: Column, pop: bool = False) -> Column:
    present = _count(cells)
    mean = row_average(*cells)
    squares = [F.coalesce(F.pow(number(cell) - mean, F.lit(2)), F.lit(0.0)) for cell in cells]
    divisor = present if pop else F.greatest(present - 1, F.lit(0))
    return F.sqrt(reduce(add, squares) / F.nullif(divisor, F.lit(0)))


def column_sum(cell: Column) -> Column:
    return F.coalesce(F.sum(number(cell)), F.lit(0.0))


def column_average(cell: Column) -> Column:
    return F.avg(number(cell))


def column_stddev(cell: Column, pop: bool = False) -> Column:
    return (F.stddev_pop if pop else F.stddev_samp)(number(cell))


def block_sum(*cells: Column) -> Column:
    return reduce(add, [column_sum(cell) for cell in cells])


def block_average(*cells: Column) -> Column:
    counted = reduce(add, [F.count(number(cell)) for cell in cells])
    return block_sum(*cells) / F.nullif(counted, F.lit(0))


def block_stddev(df: DataFrame, columns: list[str], by: list[str] = (), pop: bool = False) -> DataFrame:
    """Several columns as one population; the cells are stacked, not squared and summed."""
    values = F.explode(F.array(*[number(F.col(name)) for name in columns])).alias("value")
    spread = F.stddev_pop if pop else F.stddev_samp
    return df.select(*by, values).groupBy(*by).agg(spread("value").alias("stddev"))
