"""The long form every whole-column decision works on.

``cells(dataset, column, text, tag, _row)`` has one row per cell, so one job
profiles one wide table or thousands of small ones alike, and the grouped
aggregation behind it combines on the map side: however large a dataset is,
each task ships one small row per column.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "_row"

# How a cell's native type is tagged.
TAGS = ("null", "bool", "int", "float", "str", "date", "datetime")


def tag_of(field: T.DataType) -> str:
    if isinstance(field, T.BooleanType):
        return "bool"
    if isinstance(field, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(field, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(field, T.DateType):
        return "date"
    if isinstance(field, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "str"


def as_text(cell: Column, field: T.DataType) -> Column:
    """The text a cell prints as; datetimes always show their time of day."""
    if tag_of(field) == "datetime":
        whole = F.date_format(cell, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(cell, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
    return cell.cast("string")


def with_row(df: DataFrame) -> DataFrame:
    """Keep a source order that is already there; otherwise number the scan."""
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def melt(df: DataFrame, columns: list[str] | None = None, dataset: str | Column = "") -> DataFrame:
    """Wide to long; the tag of a cell comes from its column's type."""
    df = with_row(df)
    columns = columns or [name for name in df.columns if name != ROW]
    cells = []
    for position, name in enumerate(columns):
        field = df.schema[name].dataType
        cell = F.col(f"`{name}`")
        cells.append(
            F.struct(
                F.lit(position).alias("pos"),
                F.lit(name).alias("column"),
                as_text(cell, field).alias("text"),
                F.when(cell.isNull(), "null").otherwise(tag_of(field)).alias("tag"),
            )
        )
    label = F.lit(dataset) if isinstance(dataset, str) else dataset
    return df.select(label.alias("dataset"), ROW, F.inline(F.array(*cells)))
