"""Tables found in running text, proposed and gated by approval.

A document is one value, so its lines, widths and runs are worked out inside
the row: no shuffle, and a document with a third of all lines is still one row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.cells import ROW
from tessera.operators.profile import profile

# Separators of tabulatable text.
SEPARATORS = (",", ";", "\t", "|")
PIPE_ROW = r"\A\s*\|.*\|\s*\z"
PIPE_RULE = r"\A\s*\|(?:\s*:?-+:?\s*\|)+\s*\z"


def _runs(widths: Column) -> Column:
    """Maximal runs of equal widths: ``array<struct<first, last, width>>``."""
    places = F.sequence(F.lit(0), F.size(widths) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(widths, i) != F.get(widths, i - 1)))
    with_end = F.concat(starts, F.array(F.size(widths)))
    return F.transform(
        starts,
        lambda start, n: F.struct(
            start.alias("first"),
            (F.get(with_end, n + 1) - 1).alias("last"),
            F.get(widths, start).alias("width"),
        ),
    )


def _found(docs: DataFrame, key: str, text: str, widths: dict[str, Column]) -> DataFrame:
    """Runs of lines of one width under each separator, all from one reading of the texts."""
    staged = docs.select(F.col(key).alias("doc"), F.split(F.col(text), "\n").alias("lines"))
    staged = staged.withColumns({f"_w{n}": width for n, width in enumerate(widths.values())})

    def runs(n: int, sep: str) -> Column:
        wide = F.filter(_runs(F.col(f"_w{n}")), lambda r: (r["width"] >= 2) & (r["last"] > r["first"]))
        return F.transform(wide, lambda r: F.struct(F.lit(sep).alias("sep"), r.alias("run")))

    listed = staged.select("doc", "lines", F.explode(F.concat(*(runs(n, sep) for n, sep in enumerate(widths)))).alias("x"))
    return listed.select(
        "doc",
        F.col("x.sep").alias("sep"),
        F.col("x.run.width").alias("width"),
        F.col("x.run.first").alias("first_line"),
        F.col("x.run.last").alias("last_line"),
        F.expr("slice(lines, x.run.first + 1, x.run.last - x.run.first + 1)").alias("lines"),
        # What stands above a table may be its name.
        F.trim(F.get("lines", F.col("x.run.first") - 1)).alias("title"),
    )


def text_records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of at least two lines with the same number (two or more) of fields."""

    def width(sep: str) -> Column:
        return F.transform("lines", lambda line: F.length(line) - F.length(F.replace(line, F.lit(sep), F.lit(""))) + 1)

    return _found(docs, key, text, {sep: width(sep) for sep in SEPARATORS})


def pipe_tables(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of ``| a | b |`` lines of one width; the dashed rule is not a row, and null among ``lines``."""
    def width(line: Column) -> Column:
        fields = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) - 1
        return F.when(line.rlike(PIPE_ROW), fields).otherwise(F.lit(0))

    found = _found(docs, key, text, {"|": F.transform("lines", width)})
    rows = F.transform("lines", lambda line: F.when(~line.rlike(PIPE_RULE), line))
    return found.withColumn("lines", rows).filter(F.size(F.array_compact("lines")) >= 2)


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``[doc, table_no, row_no, fields]`` of ``<table>`` markup."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1))
    listed = pages.select(F.col(key).alias("doc"), F.posexplode(tables).alias("table_no", "inner"))
    rows = F.regexp_extract_all("inner", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    split = listed.select("doc", "table_no", F.posexplode(rows).alias("row_no", "row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    plain = F.transform(cells, lambda cell: F.trim(F.regexp_replace(cell, r"<[^>]*>", "")))
    return split.select("doc", "table_no", "row_no", plain.alias("fields"))


def _parts(line: Column, sep: Column) -> Column:
    """Fields of a line; the bars around a pipe row are not fields."""
    bare = F.when(
        (sep == "|") & line.rlike(PIPE_ROW), F.regexp_replace(F.regexp_replace(line, r"\A\s*\|", ""), r"\|\s*\z", "")
    ).otherwise(line)
    quoted = F.when(sep == "|", F.lit("[|]")).otherwise(sep)
    return F.transform(F.split(bare, quoted), lambda part: F.trim(part))


def merged(found: DataFrame) -> DataFrame:
    """``[candidate, doc, sep, header, title, line_no, fields]``: data rows per logical table.

    Runs of a document that open with the same header are pieces of one table
    (a page break repeats the header); every repetition of the header is dropped.
    """
    header = F.get(F.array_compact("lines"), F.lit(0))
    rows = found.select(
        "doc",
        "sep",
        header.alias("header"),
        F.posexplode(F.col("lines")).alias("offset", "line"),
        "first_line",
        "title",
    ).filter("line <> header")
    return rows.select(
        F.concat_ws("/", F.col("doc").cast("string"), F.hex(F.xxhash64("sep", "header"))).alias("candidate"),
        "doc",
        "sep",
        "header",
        "title",
        (F.col("first_line") + F.col("offset")).alias("line_no"),
        _parts(F.col("line"), F.col("sep")).alias("fields"),
    )


def candidate_cells(rows: DataFrame) -> DataFrame:
    """Merged rows as long cells, one dataset per candidate."""
    labels = _parts(F.col("header"), F.col("sep"))
    listed = rows.select("candidate", "line_no", labels.alias("labels"), F.posexplode("fields").alias("pos", "text"))
    text = F.nullif("text", F.lit(""))
    return listed.select(
        F.col("candidate").alias("dataset"),
        "pos",
        F.get("labels", F.col("pos")).alias("column"),
        text.alias("text"),
        F.when(text.isNull(), "null").otherwise("str").alias("tag"),
        F.col("line_no").alias(ROW),
    )


def proposal(rows: DataFrame) -> DataFrame:
    """Per candidate column: label, type, kind, estimated rows and a caveat."""
    decided = profile(candidate_cells(rows)).withColumnRenamed("dataset", "candidate")
    caveat = F.when(F.col("nulled") > 0, F.concat(F.col("nulled").cast("string"), F.lit(" cells become NULL")))
    return decided.select(
        "candidate", F.col("column").alias("label"), "type", "kind", F.col("row_count").alias("estimated_rows"), caveat.alias("caveat")
    )


def candidate_names(rows: DataFrame) -> DataFrame:
    """``[candidate, doc, name, first_line, last_line]``: a name to propose, and where a table stands.

    The name is the line above the first piece of the table, or the table's labels.
    """
    title = F.nullif(F.min_by("title", "line_no"), F.lit(""))
    labels = F.concat_ws(" ", F.filter(_parts(F.first("header"), F.first("sep")), lambda label: label != ""))
    return rows.groupBy("candidate", "doc").agg(F.coalesce(title, labels).alias("name"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def proposals(rows: DataFrame, n: int = 5) -> DataFrame:
    """One row per candidate: all that an approval is decided on.

    ``[candidate, doc, name, first_line, last_line, labels, types, estimated_rows,
    caveats, first_rows]``; labels, types and rows are in their order in the text.
    """
    places = candidate_cells(rows).select(F.col("dataset").alias("candidate"), F.col("column").alias("label"), "pos").distinct()
    column = F.struct("pos", "label", "type", F.when(F.col("caveat").isNotNull(), F.concat("label", F.lit(": "), "caveat")).alias("caveat"))
    # A table has as many columns as a line has fields.
    columns = proposal(rows).join(places, ["candidate", "label"]).groupBy("candidate").agg(F.array_sort(F.collect_list(column)).alias("c"), F.max("estimated_rows").alias("estimated_rows"))
    shown = preview(rows, n).groupBy("candidate").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row"))), lambda x: x["row"]).alias("first_rows"))
    return candidate_names(rows).join(columns, "candidate").join(shown, "candidate", "left").select(
        "candidate", "doc", "name", "first_line", "last_line", F.col("c.label").alias("labels"), F.col("c.type").alias("types"),
        "estimated_rows", F.filter("c.caveat", lambda x: x.isNotNull()).alias("caveats"), "first_rows",
    )


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of every candidate in source order."""
    order = W.partitionBy("candidate").orderBy("line_no")
    return (
        rows.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("candidate", "rank", F.concat_ws(" | ", "fields").alias("row"))
    )


def approved(proposed: DataFrame, approvals: DataFrame) -> DataFrame:
    """Only what was approved goes on to storage."""
    return proposed.join(approvals.filter("approved").select("candidate"), "candidate", "left_semi")


def approved_tables(proposed: DataFrame, rows: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, cells and provenance of what was approved, as a store takes them.

    A document is a source, a candidate one of its datasets, by the name it was
    proposed with; of candidates of a document that share a name, those below the
    first have their first line in it. ``proposed`` are :func:`candidate_names`.
    """
    kept = approved(proposed, approvals)
    order = W.partitionBy("doc", "name").orderBy("first_line", "candidate")
    named = kept.withColumn("_nth", F.row_number().over(order))
    name = F.when(F.col("_nth") == 1, F.col("name")).otherwise(F.concat_ws(" ", "name", "first_line", "_nth"))
    source = F.concat(F.lit("document "), F.col("doc").cast("string"))
    named = named.select("candidate", source.alias("source_id"), name.alias("dataset"), "doc", "first_line", "last_line")
    cells = candidate_cells(rows).withColumnRenamed("dataset", "candidate").join(named.select("candidate", "source_id", "dataset"), "candidate").drop("candidate")
    lines = F.concat(F.lit("lines "), (F.col("first_line") + 1).cast("string"), F.lit("-"), (F.col("last_line") + 1).cast("string"))
    provenance = named.select("source_id", "dataset", F.lit(None).cast("bigint").alias("source_page"), lines.alias("source_section"), F.lit(None).cast("string").alias("source_sheet"))
    sources = named.groupBy("source_id").agg(F.concat(F.lit("documents/"), F.first("doc").cast("string")).alias("source_resource"))
    return sources, cells, provenance


def gate_status(proposed: DataFrame, approvals: DataFrame) -> DataFrame:
    """``[candidate, status]``: approved, rejected or pending."""
    verdict = F.when(F.col("approved"), "approved").when(~F.col("approved"), "rejected").otherwise("pending")
    return (
        proposed.select("candidate").distinct().join(approvals, "candidate", "left").select("candidate", verdict.alias("status"))
    )


def extraction_status(
    reader: Column, readable: Column, regular: Column, rows: Column, decision: Column, saved: Column
) -> Column:
    """One explicit status per source; the first obstacle names it."""
    return (
        F.when(reader == "unsupported", "unsupported")
        .when(~readable, "failed")
        .when(~regular, "malformed")
        .when(rows == 0, "non-tabular")
        .when(decision == "rejected", "rejected")
        .when(decision == "pending", "pending")
        .when(saved, "complete")
        .otherwise("failed")
    )
