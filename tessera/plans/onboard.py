"""A folder of mixed files: routed to their readers, every outcome in one table, and stored together."""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cells import ROW
from tessera.operators.worksheet import duplicate_labels, layout, to_cells
from tessera.plans.bulk import persist_many
from tessera.session import checkpointed
from tessera.sources.delimited import duplicate_headers, header_labels, read_cells
from tessera.sources.files import DELIMITED, SCHEME, file_checksums, is_contained, listing, reader_for, resolved
from tessera.sources.manifest import manifest_cells, read_manifests

#: Between a workbook and the name of one of its sheets.
MARK = "\x1f"


@dataclass
class Routed:
    """What the files below a folder hold: long cells of all that can be read, and a status for each file.

    ``cells[file, dataset, pos, column, text, tag, _row, sheet]`` and ``status[file,
    length, reader, status, n_rows, detail]``.
    """

    cells: DataFrame
    status: DataFrame


def route(spark: SparkSession, path: str, raw_root: str | None = None, worksheets: DataFrame | None = None, sep: str | None = None, listed: DataFrame | None = None) -> Routed:
    """Every file below ``path`` to its reader, from one listing.

    A listing of ``path`` that was made and kept before may come as ``listed`` (path, length).

    Delimited files are scanned together, whatever their headers. Workbooks come
    as cells in ``worksheets`` (file, sheet, row, col, value, value_type,
    is_formula); one without cells there is ``unread``. Files outside ``raw_root``
    are ``outside``, those nothing reads ``unsupported``, and those without a row
    of content ``non-tabular``. ``detail`` names a doubled label and its places.
    """
    found = listing(spark, path) if listed is None else listed
    files = found.select(F.col("path").alias("file"), "length", reader_for(F.col("path")).alias("reader"))
    # A folder named without a scheme is one of the file system the files are in.
    place = F.col("file") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", raw_root or "") else F.regexp_replace("file", SCHEME, "")
    files = checkpointed(spark, files.withColumn("inside", is_contained(place, raw_root) if raw_root else F.lit(True)))
    cells = spark.createDataFrame([], f"file string, dataset string, pos int, column string, text string, tag string, {ROW} struct<block:bigint,id:bigint>, sheet string")
    found = spark.createDataFrame([], "file string, read string, n_rows bigint, detail string")
    if not files.where("inside AND reader = 'delimited'").isEmpty():
        read, scanned = read_cells(spark, path, sep, DELIMITED, files.where("reader = 'delimited'"))
        doubled = duplicate_headers(header_labels(scanned.withColumn("status", F.when(F.col("status") == "duplicate header", "complete").otherwise(F.col("status")))))
        first = doubled.groupBy("file").agg(F.min(F.struct("first_pos", "last_pos", "label")).alias("d"))
        why = F.format_string("%s at columns %d and %d", "d.label", "d.first_pos", "d.last_pos")
        outcome = F.when((F.col("status") == "complete") & (F.col("n_rows") == 0) | (F.col("status") == "empty"), "non-tabular").otherwise(F.col("status"))
        found = found.unionByName(scanned.join(first, "file", "left").select("file", outcome.alias("read"), "n_rows", F.when(F.col("d").isNotNull(), why).alias("detail")))
        stem = F.regexp_replace(F.substring_index("dataset", "/", -1), r"\.[^.]*\z", "")
        own = read.select(F.col("dataset").alias("file"), stem.alias("dataset"), "pos", "column", "text", "tag", ROW, F.lit(None).cast("string").alias("sheet"))
        cells = cells.unionByName(own.join(files.where("inside").select("file"), "file", "left_semi").select(own.columns))
    if worksheets is not None:
        books = worksheets.join(files.where("inside AND reader = 'worksheet'").select("file"), "file", "left_semi")
        marked = books.withColumn("sheet", F.concat_ws(MARK, "file", "sheet")).drop("file")
        shape = checkpointed(spark, layout(marked))
        file = F.substring_index("sheet", MARK, 1).alias("file")
        doubled = duplicate_labels(shape).select(file, "sheet", "label", "first_pos", "last_pos")
        first = doubled.groupBy("file").agg(F.min(F.struct("sheet", "first_pos", "last_pos", "label")).alias("d"))
        why = F.format_string("%s in %s at columns %d and %d", "d.label", F.substring_index("d.sheet", MARK, -1), "d.first_pos", "d.last_pos")
        long = to_cells(marked, shape)
        book = F.substring_index("dataset", MARK, 1).alias("file")
        rows = long.groupBy(book).agg(F.count_distinct("dataset", ROW).alias("n_rows"))
        seen = books.select("file").distinct().join(rows, "file", "left").join(first, "file", "left")
        outcome = F.when(F.col("d").isNotNull(), "duplicate header").when(F.col("n_rows").isNull(), "non-tabular").otherwise("complete")
        found = found.unionByName(seen.select("file", outcome.alias("read"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.when(F.col("d").isNotNull(), why).alias("detail")))
        title = F.substring_index("dataset", MARK, -1)
        row = F.struct(F.lit(0).cast("bigint").alias("block"), F.col(ROW).cast("bigint").alias("id"))
        own = long.select(book, title.alias("dataset"), "pos", "column", "text", "tag", row.alias(ROW), title.alias("sheet"))
        cells = cells.unionByName(own)
    status = (
        F.when(~F.col("inside"), "outside")
        .when(F.col("reader") == "unsupported", "unsupported")
        .otherwise(F.coalesce("read", F.when(F.col("reader") == "worksheet", "unread").otherwise("non-tabular")))
    )
    told = files.join(found, "file", "left").select("file", "length", "reader", status.alias("status"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "detail")
    told = checkpointed(spark, told)
    return Routed(cells.join(told.where("status = 'complete'").select("file"), "file", "left_semi").select(cells.columns), told)


def onboard(spark: SparkSession, root: str, path: str, raw_root: str | None = None, worksheets: DataFrame | None = None, decisions: DataFrame | None = None, sep: str | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Store all readable files below ``path`` as sources of the store, in one write and one commit.

    Returns ``[file, reader, status, n_rows, detail, source_id, n_tables]``. A file
    is a source under its path below the folder. With ``decisions`` (file,
    approved) only approved files are stored; others are ``rejected`` or ``pending``.
    ``listed`` is that of :func:`route`.
    """
    routed = route(spark, path, raw_root, worksheets, sep, listed)
    plain = [F.regexp_replace(resolved(c), SCHEME, "") for c in (F.col("file"), F.lit(path))]
    inner = plain[0].substr(F.length(plain[1]) + 2, F.length(plain[0]))
    status = routed.status
    if decisions is not None:
        verdict = F.when(F.col("approved"), "complete").when(~F.col("approved"), "rejected").otherwise("pending")
        status = status.join(decisions.select("file", "approved"), "file", "left").withColumn("status", F.when(F.col("status") == "complete", verdict).otherwise(F.col("status"))).drop("approved")
    status = checkpointed(spark, status.withColumn("source_id", inner))
    good = status.where("status = 'complete'")
    sums = file_checksums(good.select(F.col("file").alias("path"), "length")).select(F.col("path").alias("file"), "checksum")
    sources = good.join(sums, "file").select("source_id", F.col("file").alias("source_resource"), F.concat(F.lit("wiki/sources/"), "source_id", F.lit(".md")).alias("summary_page"), F.col("checksum").alias("content_checksum"))
    cells = routed.cells.join(good.select("file", "source_id"), "file")
    places = cells.where(F.col("sheet").isNotNull()).select("source_id", "dataset", F.lit(None).cast("bigint").alias("source_page"), F.lit(None).cast("string").alias("source_section"), F.col("sheet").alias("source_sheet")).distinct()
    if not good.isEmpty():
        stored = persist_many(spark, root, sources, cells.drop("file", "sheet"), places)
        tables = stored.groupBy("source_id").agg(F.count_distinct("table_name").alias("n_tables"))
        status = status.join(tables, "source_id", "left")
    else:
        status = status.withColumn("n_tables", F.lit(0).cast("bigint"))
    return status.select("file", "reader", "status", "n_rows", "detail", "source_id", F.coalesce("n_tables", F.lit(0)).alias("n_tables"))


def onboard_manifests(spark: SparkSession, root: str, path: str, per_line: bool = False, rebuild: bool = False) -> DataFrame:
    """Store all datasets of the manifests below ``path``, however many sources they name, in one write and one commit.

    Returns what :func:`persist_many` does. A source has one manifest, and its
    datasets have different names.
    """
    found = read_manifests(spark, path, per_line)
    listed = found.select("source_id", "file", "pos", F.col("dataset.name").alias("dataset"))
    listed = checkpointed(spark, listed)
    twice = listed.groupBy("source_id", "dataset").agg(F.count("*").alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"nothing was stored: {twice.source_id!r} has two datasets named {twice.dataset!r}")
    sums = file_checksums(listing(spark, path).select("path", "length"))
    sources = listed.groupBy("source_id").agg(F.min("file").alias("path")).join(sums, "path", "left")
    sources = sources.select("source_id", F.col("path").alias("source_resource"), F.concat(F.lit("wiki/sources/"), "source_id", F.lit(".md")).alias("summary_page"), F.col("checksum").alias("content_checksum"))
    cells = manifest_cells(found)
    places = found.select("source_id", F.col("dataset.name").alias("dataset"), "dataset.source_page", "dataset.source_section", "dataset.source_sheet")
    columns = ["source_id", "dataset", "pos", "column", "text", "tag", ROW]
    return persist_many(spark, root, sources, cells.select(columns), places, rebuild)
