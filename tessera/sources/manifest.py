"""JSON manifests: datasets with typed cells, provenance and formula columns."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cells import ROW
from tessera.sources.files import source_path

DATASETS = (
    "array<struct<name:string, columns:array<string>, rows:array<map<string,variant>>, "
    "source_page:bigint, source_section:string, source_sheet:string, "
    "formulas:array<struct<column:string, formula:string, inputs:array<string>, sql:string>>>>"
)


def read_manifests(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """``[file, source_id, pos, dataset]``, one row per dataset.

    A manifest is one JSON object per file, or per line when ``per_line`` is
    set; the second form lets one large file be split.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    texts = reader.text(path, wholetext=not per_line).select(
        source_path().alias("file"),
        F.from_json("value", f"struct<source_id:string, datasets:{DATASETS}>").alias("m"),
    )
    return texts.filter("m.source_id is not null or m.datasets is not null").select(
        "file", F.col("m.source_id").alias("source_id"), F.posexplode("m.datasets").alias("pos", "dataset")
    )


def mismatched(manifests: DataFrame, expected: str) -> DataFrame:
    """Manifests that name another source than the caller asked for."""
    other = F.coalesce(F.col("source_id") != expected, F.lit(True))
    return manifests.filter(other).select("file", "source_id").distinct()


def _beyond_64_bits(cell, kind):
    """A whole number too large for a BIGINT: a decimal without a fraction."""
    return kind.rlike(r"^DECIMAL\(\d+,0\)$") & (F.abs(cell.cast("decimal(38,0)")) > F.lit(2**63 - 1).cast("decimal(38,0)"))


def manifest_cells(manifests: DataFrame) -> DataFrame:
    """Typed cells of all datasets: every listed column of every row, in row order."""
    calculated = F.coalesce(F.col("dataset.formulas.column"), F.array().cast("array<string>"))
    rows = manifests.select(
        "source_id",
        F.col("dataset.name").alias("dataset"),
        F.col("dataset.source_page").alias("source_page"),
        F.col("dataset.source_section").alias("source_section"),
        F.col("dataset.source_sheet").alias("source_sheet"),
        F.array_except("dataset.columns", calculated).alias("columns"),
        F.posexplode("dataset.rows").alias(ROW, "cells"),
    )
    cell = F.try_element_at("cells", F.col("column"))
    kind = F.schema_of_variant(cell)
    tag = (
        F.when(cell.isNull() | (kind == "VOID"), "null")
        .when((kind == "BIGINT") | _beyond_64_bits(cell, kind), "int")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "STRING", "str")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .otherwise("other")
    )
    exploded = rows.select("*", F.posexplode("columns").alias("pos", "column")).drop("columns")
    printed = cell.cast("string")
    # A variant drops trailing zeros; a number written with a point keeps one.
    whole = (tag == "float") & printed.rlike(r"\A-?[0-9]+\z")
    text = F.when(whole, F.concat(printed, F.lit(".0"))).otherwise(printed)
    return exploded.withColumns({"text": text, "tag": tag}).drop("cells")
