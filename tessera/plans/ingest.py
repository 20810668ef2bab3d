"""From raw files, manifests and worksheets to datasets, and their inspection."""
from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cells import ROW, as_text, melt
from tessera.operators.formulas import column_formulas
from tessera.operators.profile import first_rows, normalized_text, profile
from tessera.operators.worksheet import duplicate_labels, layout, to_cells
from tessera.plans.store import Dataset, stored_columns
from tessera.sources.delimited import read_delimited
from tessera.sources.files import is_contained, reader_for
from tessera.sources.manifest import manifest_cells, mismatched, read_manifests


def load_file(spark: SparkSession, path: str, raw_root: str) -> list[Dataset]:
    """The dataset of one delimited file below the raw folder; none if it is empty."""
    checked = spark.range(1).select(
        is_contained(F.lit(path), raw_root).alias("inside"), reader_for(F.lit(path)).alias("reader")
    ).first()
    if not checked.inside:
        raise ValueError(f"{path} does not lie below the raw folder {raw_root}")
    if checked.reader == "worksheet":
        raise ValueError(f"{path} is a workbook: pass its cells to sheet_datasets")
    if checked.reader == "unsupported":
        raise ValueError(f"no reader for {path}")
    try:
        df, status = read_delimited(spark, path)
    except LookupError:
        return []
    bad = status.filter("status IN ('malformed', 'unclosed quote')").first()
    if bad is not None:
        raise ValueError(f"{bad.file} has no constant row width ({bad.status})")
    return [Dataset(posixpath.splitext(posixpath.basename(path))[0], df)]


def _wide(cells: DataFrame, columns: list[str]) -> DataFrame:
    texts = cells.groupBy(ROW).pivot("column", columns).agg(F.first("text"))
    return texts.select(ROW, *[F.col(f"`{name}`") for name in columns])


def manifest_datasets(spark: SparkSession, path: str, source_id: str) -> list[Dataset]:
    """The datasets of a manifest that names ``source_id``; formula columns are left out."""
    found = read_manifests(spark, path)
    if not mismatched(found, source_id).isEmpty():
        raise ValueError(f"the manifest at {path} belongs to another source than {source_id!r}")
    # One row per dataset: its name, labels and provenance, not its rows.
    listed = found.select(
        "file", "pos", "dataset.name", "dataset.columns", "dataset.source_page", "dataset.source_section",
        "dataset.source_sheet", F.coalesce("dataset.formulas.column", F.array().cast("array<string>")).alias("calculated"), "dataset.formulas",
    ).orderBy("file", "pos")
    datasets = []
    for row in listed.collect():
        own = found.filter((F.col("file") == row.file) & (F.col("pos") == row.pos))
        cells = manifest_cells(own)
        columns = [c for c in row.columns if c not in row.calculated]
        datasets.append(
            Dataset(row.name, _wide(cells, columns), row.source_page, row.source_section, row.source_sheet, cells=cells,
                    formulas=[{k: f[k] for k in ("column", "formula", "inputs")} for f in row.formulas or ()])
        )
    return datasets


def sheet_datasets(cells: DataFrame) -> list[Dataset]:
    """One dataset per worksheet that has a header and rows of its own."""
    shape = layout(cells)
    doubled = duplicate_labels(shape).first()
    if doubled is not None:
        raise ValueError(
            f"duplicate header {doubled.label!r} in {doubled.sheet!r} at columns {doubled.first_pos} and {doubled.last_pos}"
        )
    long = to_cells(cells, shape)
    kept = shape.filter("not calculated").join(long.select(F.col("dataset").alias("sheet")).distinct(), "sheet", "left_semi")
    labels: dict[str, list[str]] = {}
    for row in kept.orderBy("sheet", "col").collect():
        labels.setdefault(row.sheet, []).append(row.label)
    # One row per calculated column.
    calculated: dict[str, list[dict]] = {}
    for row in column_formulas(cells, shape).orderBy("sheet", "col").collect():
        facts = row.asDict()
        calculated.setdefault(facts.pop("sheet"), []).append(facts)
    return [
        Dataset(sheet, _wide(own, names), source_sheet=sheet, cells=own, formulas=calculated.get(sheet, []))
        for sheet, names in labels.items()
        for own in [long.filter(F.col("dataset") == sheet)]
    ]


def inspect(dataset: Dataset) -> dict:
    """Columns with type and kind, row count, formulas and five normalized rows; nothing is written."""
    columns = stored_columns(dataset)
    cells = melt(dataset.df, columns) if dataset.cells is None else dataset.cells
    found = {row.column: row for row in profile(cells).collect()}
    decided = {c: (found[c].type, found[c].kind) if c in found else ("VARCHAR", None) for c in columns}
    shown = [
        normalized_text(as_text(F.col(f"`{c}`"), dataset.df.schema[c].dataType), F.lit(decided[c][1]).cast("string")).alias(c)
        for c in columns
    ]
    sample = first_rows(dataset.df).select(*shown).collect()
    return {
        "name": dataset.name,
        "columns": [{"name": c, "type": decided[c][0], "kind": decided[c][1]} for c in columns],
        "row_count": max((row.row_count for row in found.values()), default=0),
        "sample": [row.asDict() for row in sample],
        "formulas": dataset.formulas,
        "source_page": dataset.source_page,
        "source_section": dataset.source_section,
        "source_sheet": dataset.source_sheet,
    }
