"""Worksheets given as cells ``(sheet, row, col, value, value_type, is_formula)``.

Rows and columns are 1-based as in the sheet. Everything a sheet decides about
its columns fits into one small layout row per column; it is worked out once,
in two map-side combined aggregations, and joins back on the sheet. AQE splits
the join for a sheet that holds most of the rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cells import ROW
from tessera.session import checkpointed, small


def _filled() -> Column:
    return F.coalesce(F.col("value") != "", F.lit(False))


def layout(cells: DataFrame) -> DataFrame:
    """``[sheet, header_row, col, label, calculated, numeric]`` per used column.

    The header is the first row with any content. A column with a formula below
    it is ``calculated``; ``numeric`` says that every cell below it is a number
    (booleans are not) and is NULL for a column without cells.
    """
    filled = cells.filter(_filled())
    tops = filled.groupBy("sheet").agg(F.min("row").alias("header_row"), F.max("col").alias("last"))
    # One row per sheet goes to the cells, which stay where they are.
    tops = small(checkpointed(cells.sparkSession, tops))
    placed = filled.join(tops.select("sheet", "header_row"), "sheet")
    below = F.col("row") > F.col("header_row")
    # Flags only, so that cells are combined by hashing; a text among them would have them all sorted.
    flags = placed.groupBy("sheet", "col").agg(
        F.coalesce(F.bool_or(below & F.col("is_formula")), F.lit(False)).alias("calculated"),
        F.bool_and(F.when(below, F.col("value_type").isin("int", "float"))).alias("numeric"),
    )
    labels = placed.filter(~below).groupBy("sheet", "col").agg(F.max("value").alias("label"))
    columns = flags.join(labels, ["sheet", "col"], "left")
    every = tops.select("sheet", "header_row", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("col"))
    joined = every.join(columns, ["sheet", "col"], "left").select(
        "sheet",
        "header_row",
        "col",
        F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce("calculated", F.lit(False)).alias("calculated"),
        "numeric",
    )
    return checkpointed(cells.sparkSession, joined)


def headers(shape: DataFrame) -> DataFrame:
    return shape.select("sheet", "col", "label")


def formula_columns(shape: DataFrame) -> DataFrame:
    """``[sheet, col]`` with at least one formula; they are left out of storage."""
    return shape.filter("calculated").select("sheet", "col")


def _data(cells: DataFrame, shape: DataFrame) -> DataFrame:
    facts = small(shape.select("sheet", "col", "header_row", "calculated"))
    placed = cells.filter(_filled()).join(facts, ["sheet", "col"])
    return placed.filter("row > header_row").drop("header_row")


def stored_cells(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """Filled data cells outside formula columns; rows left empty vanish."""
    return _data(cells, shape).filter("not calculated").drop("calculated")


def stored_spread(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """``[sheet, first_row, last_row]`` of the rows that keep some value."""
    return stored_cells(cells, shape).groupBy("sheet").agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row")
    )


def dropped_rows(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """``[sheet, row]`` whose only content is in formula columns."""
    return (
        _data(cells, shape)
        .groupBy("sheet", "row")
        .agg(F.bool_and("calculated").alias("only_formulas"))
        .filter("only_formulas")
        .select("sheet", "row")
    )


def numeric_columns(shape: DataFrame) -> DataFrame:
    """``[sheet, col, numeric]`` of the stored columns with content."""
    return shape.filter("not calculated and numeric is not null").select("sheet", "col", "numeric")


def to_cells(cells: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """Sheets with a header and data as long cells, one dataset per sheet.

    Every stored row answers every stored column, so absent cells come out as
    NULL. A row has at most as many cells as a sheet has columns, so grouping
    by row is bounded; the labels of a sheet travel as one array.
    """
    shape = layout(cells) if shape is None else shape
    rows = stored_cells(cells, shape).groupBy("sheet", "row").agg(
        F.map_from_entries(
            F.collect_list(F.struct("col", F.struct(F.col("value").alias("text"), F.col("value_type").alias("tag"))))
        ).alias("filled")
    )
    labels = (
        shape.filter("not calculated")
        .groupBy("sheet")
        .agg(F.array_sort(F.collect_list(F.struct("col", "label"))).alias("labels"))
    )
    # The checked labels go to the rows, which stay where they were grouped.
    listed = rows.join(small(checkpointed(cells.sparkSession, labels)), "sheet").select(
        F.col("sheet").alias("dataset"),
        F.col("row").alias(ROW),
        "filled",
        F.posexplode("labels").alias("pos", "header"),
    )
    cell = F.try_element_at("filled", F.col("header.col"))
    return listed.select(
        "dataset",
        "pos",
        F.col("header.label").alias("column"),
        cell["text"].alias("text"),
        F.coalesce(cell["tag"], F.lit("null")).alias("tag"),
        ROW,
    )


def to_table(cells: DataFrame, sheet: str) -> DataFrame:
    """One sheet as a wide table of texts."""
    own = cells.filter(F.col("sheet") == sheet)
    shape = layout(own)
    labels = [row.label for row in shape.filter("not calculated").orderBy("col").collect()]
    return to_cells(own, shape).groupBy(ROW).pivot("column", labels).agg(F.first("text"))


def duplicate_labels(shape: DataFrame) -> DataFrame:
    """Labels a sheet uses twice, two blank ones included, with their places."""
    return (
        shape.groupBy("sheet", "label")
        .agg(F.count("*").alias("n"), F.min("col").alias("first_pos"), F.max("col").alias("last_pos"))
        .filter("n > 1")
    )
