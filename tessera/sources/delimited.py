"""CSV and TSV files of any size.

Files are read as lines, so a large file is split like any other text. Quoted
fields may hold line breaks; whether a line starts inside such a field depends
on all lines before it, but each line only maps {outside, inside} to
{outside, inside}, and such maps compose. So the state is settled inside every
split on its own, the splits of a file are chained through one small row each,
and only the lines that belong to a broken record are ever regrouped.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.cells import ROW
from tessera.session import OPEN_COST, checkpointed, reading, small
from tessera.sources.files import default_separator, listing, source_path

# Separators tried when the default gives ragged rows.
CANDIDATES = (",", ";", "\t", "|")

MAX_COLUMNS = 20480

#: Bytes of a split. The lines of a split lie in one task while they are stitched, and
#: short lines take many times their bytes there.
SPLIT = 2 << 20
MAX_PARTITIONS = 20000


def _unquoted(record: Column, sep: str) -> Column:
    """The record without its completed quoted fields."""
    mark = re.escape(sep)
    body = f'(\\A|{mark})"[^"]*+(?:""[^"]*+)*+"'
    return F.when(record.contains('"'), F.regexp_replace(record, body, "$1")).otherwise(record)


def _leaves_open(record: Column, sep: str) -> Column:
    mark = re.escape(sep)
    return record.contains('"') & _unquoted(record, sep).rlike(f'(?:\\A|{mark})"')


def _width(record: Column, sep: str) -> Column:
    rest = _unquoted(record, sep)
    return F.length(rest) - F.length(F.replace(rest, F.lit(sep), F.lit(""))) + 1


def _is_blank_record(record: Column, sep: str) -> Column:
    """Nothing but separators and empty quoted fields."""
    mark = re.escape(sep)
    return record.rlike(f'\\A(?:"")?(?:{mark}(?:"")?)*+\\z')


def read_lines(spark: SparkSession, path: str | list[str], names: str = "*") -> DataFrame:
    """``[file, block, id, record]``; (block, id) is source order inside a file.

    The reader drops a byte order mark from the first line of a file.
    """
    read = reading(spark, SPLIT).read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(path)
    lines = DataFrame(read._jdf, spark)
    return lines.select(
        source_path().alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("record"),
    )


def _chained(reset: Column, flips: Column, start: Column) -> Column:
    return (F.coalesce(reset, start) + flips) % 2


def stitch(lines: DataFrame, sep: str) -> tuple[DataFrame, DataFrame]:
    """Lines to records, joining lines that share a quoted field; and the files whose last quote stays open.

    Such files have no records: what follows the quote is never regrouped.
    """
    # Some partitions for each split: sizes left to the optimizer would put many splits into one task.
    size = int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    lines = lines.repartition(max(lines.sparkSession.sparkContext.defaultParallelism, min(-(-size // SPLIT), MAX_PARTITIONS)), "file", "block")
    quoted = F.col("record").contains('"')
    after_out = _leaves_open(F.col("record"), sep).cast("int")
    after_in = F.when(quoted, _leaves_open(F.concat(F.lit('"'), F.col("record")), sep).cast("int")).otherwise(1)
    inside_split = W.partitionBy("file", "block").orderBy("id")
    so_far = inside_split.rowsBetween(W.unboundedPreceding, 0)
    mapped = lines.withColumns({"_out": after_out, "_in": after_in})
    # A line forgets the state before it (same outcome either way), flips it or keeps it.
    flips = F.sum(F.when((F.col("_out") == 1) & (F.col("_in") == 0), 1).otherwise(0)).over(so_far)
    counted = mapped.withColumn("_flips", flips % 2)
    constant = F.when(F.col("_out") == F.col("_in"), (F.col("_out") + F.col("_flips")) % 2)
    known = counted.withColumn("_reset", F.last(constant, ignorenulls=True).over(so_far))

    # One row per split, chained in order.
    ends = known.groupBy("file", "block").agg(F.max_by(F.struct("_reset", "_flips"), "id").alias("end"))
    splits = W.partitionBy("file").orderBy("block")
    upto = splits.rowsBetween(W.unboundedPreceding, 0)
    ends = ends.withColumn("_flips", F.sum("end._flips").over(upto) % 2)
    settled = F.when(
        F.col("end._reset").isNotNull(), (F.col("end._reset") + F.col("end._flips") + F.col("_flips")) % 2
    )
    ends = ends.withColumn("_reset", F.last(settled, ignorenulls=True).over(upto))
    ends = ends.withColumn("_state", _chained(F.col("_reset"), F.col("_flips"), F.lit(0)))
    whole_file = splits.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = ends.select(
        "file",
        "block",
        F.coalesce(F.lag("_state").over(splits), F.lit(0)).alias("_start"),
        (F.last("_state").over(whole_file) == 1).alias("_unclosed"),
    )
    starts = checkpointed(lines.sparkSession, starts)
    unclosed = starts.filter("_unclosed").select("file").distinct()

    closed = starts.filter("not _unclosed").drop("_unclosed")
    placed = known.join(small(closed), ["file", "block"]).withColumn(
        "_after", _chained(F.col("_reset"), F.col("_flips"), F.col("_start"))
    )
    placed = placed.withColumn("_before", F.coalesce(F.lag("_after").over(inside_split), F.col("_start")))
    # Lines of a record share the place of its first line; those that continue a
    # record of an earlier split have none yet.
    first = F.when(F.col("_before") == 0, F.col("id"))
    grouped = placed.withColumn("_first", F.last(first, ignorenulls=True).over(so_far))
    # The rows already lie together by split, so this grouping moves nothing.
    pieces = grouped.groupBy("file", "block", "_first").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "record"))), lambda x: x["record"]), "\n").alias("record"),
        F.max_by("_after", "id").alias("_open"),
    )
    cut = F.col("_first").isNull() | (F.col("_open") == 1)
    whole = pieces.filter(~cut).select("file", "block", F.col("_first").alias("id"), "record")
    # At most two pieces per split reach over its edge.
    edges = pieces.filter(cut).withColumn(
        "_head", F.last(F.when(F.col("_first").isNotNull(), F.struct("block", F.col("_first").alias("id"))), ignorenulls=True).over(
            W.partitionBy("file").orderBy("block", F.col("_first").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
        )
    )
    joined = edges.groupBy("file", "_head").agg(
        F.array_sort(F.collect_list(F.struct("block", F.coalesce("_first", F.lit(-1)).alias("_first"), "record"))).alias("_parts")
    ).select(
        "file", F.col("_head.block").alias("block"), F.col("_head.id").alias("id"), F.array_join("_parts.record", "\n").alias("record")
    )
    return whole.unionByName(joined), unclosed


def _by_separator(sep: Column, rule) -> Column:
    """Apply ``rule(candidate)`` for the separator a row carries."""
    result = F.lit(None)
    for candidate in CANDIDATES:
        result = F.when(sep == candidate, rule(candidate)).otherwise(result)
    return result


#: Lines that are kept lie in so many tasks per core, at least.
READ_BY = 3

#: A file may be read under several separators; what is known of it is known for each.
READ = ["file", "sep"]


def _measure(records: DataFrame) -> DataFrame:
    """One row per file and separator: first filled record, record count, widths, open quotes."""
    record, sep = F.col("record"), F.col("sep")
    filled = ~_by_separator(sep, lambda c: _is_blank_record(record, c))
    width = _by_separator(sep, lambda c: _width(record, c))
    opens = _by_separator(sep, lambda c: _leaves_open(record, c))
    marked = records.withColumns({"_filled": filled, "_width": width, "_opens": opens})
    counted = F.when(F.col("_filled"), F.col("_width"))
    return marked.groupBy(*READ).agg(
        F.min(F.when(F.col("_filled"), F.struct("block", "id", "record"))).alias("head"),
        F.count_if("_filled").alias("n_records"),
        F.min(counted).alias("low"),
        F.max(counted).alias("high"),
        # A collected set keeps this a hash aggregation: with the text in
        # ``head`` a plain flag would make Spark sort every line by file.
        (F.size(F.collect_set(F.when(F.col("_opens"), 1))) > 0).alias("spans"),
    )


@dataclass
class Scan:
    """Records of a set of files together with one status row per file."""

    records: DataFrame
    status: DataFrame


def _settle(spark: SparkSession, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of ``lines`` (with a separator of their file) and what they measure per file and separator.

    Only files with a quoted line break are stitched.
    """
    measured = checkpointed(spark, _measure(lines)).withColumn("unclosed", F.lit(False))
    broken = measured.filter("spans").select(*READ)
    seps = [row.sep for row in broken.select("sep").distinct().collect()]
    if not seps:
        return lines, measured
    parts, facts = [lines.join(broken, READ, "left_anti")], [measured.filter("not spans")]
    for sep in seps:
        own = lines.filter(F.col("sep") == sep).join(broken, READ, "left_semi").drop("sep")
        records, unclosed = stitch(own, sep)
        parts.append(records.withColumn("sep", F.lit(sep)))
        facts.append(_measure(parts[-1]).withColumn("unclosed", F.lit(False)))
        facts.append(unclosed.withColumns({"sep": F.lit(sep), "unclosed": F.lit(True)}))
    together = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), facts)
    return reduce(DataFrame.unionByName, parts), checkpointed(spark, together)


def scan(spark: SparkSession, path: str | list[str], sep: str | None = None, names: str = "*", files: DataFrame | None = None) -> Scan:
    """Records and ``[file, sep, header, n_rows, width, status]``.

    A file whose rows all have the width of its header is ``complete``. Any other
    is read again, from its lines on, under each of the other separators, and
    accepted if one of them gives a constant width of at least two; otherwise it
    is ``malformed``, or has an ``unclosed quote``. ``files`` (file, length) that were
    listed before, all those of these ``names``, are not listed again; if to open them takes
    longer than to read their bytes, they are opened once and their lines kept.
    """
    lines = read_lines(spark, path, names)
    if files is None:
        files = listing(spark, path, names).select(F.col("path").alias("file"))
    else:
        n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if size < n * OPEN_COST:
            lines = checkpointed(spark, lines).coalesce(max(READ_BY * spark.sparkContext.defaultParallelism, size // SPLIT))
    default = F.lit(sep) if sep else default_separator(F.col("file"))
    records, measured = _settle(spark, lines.withColumn("sep", default))
    constant = (F.col("low") == F.col("high")) & ~F.col("unclosed")
    measured = measured.withColumn("use", F.when(constant, default))
    ragged = measured.filter("use IS NULL AND (unclosed OR head IS NOT NULL)").select("file")
    if not ragged.isEmpty():
        # One reading under all separators.
        again = lines.join(small(ragged), "file", "left_semi").withColumn("sep", F.explode(F.array(*map(F.lit, CANDIDATES))))
        tried, facts = _settle(spark, again)
        regular = facts.filter(constant & (F.col("low") >= 2)).withColumn("use", F.col("sep"))
        prefer = F.array_position(F.array(*map(F.lit, CANDIDATES)), F.col("sep"))
        options = regular.withColumn("_rank", F.row_number().over(W.partitionBy("file").orderBy(F.col("low").desc(), prefer)))
        best = checkpointed(spark, options.filter("_rank = 1").drop("_rank"))
        measured = measured.join(best, "file", "left_anti").unionByName(best)
        records = records.join(small(best.select("file")), "file", "left_anti").unionByName(tried.join(small(best.select(*READ)), READ, "left_semi"))
    status = files.select("file").join(measured.drop("sep"), "file", "left").select(
        "file",
        F.col("use").alias("sep"),
        F.col("head.record").alias("header"),
        F.greatest(F.coalesce(F.col("n_records") - 1, F.lit(0)), F.lit(0)).alias("n_rows"),
        F.when(F.col("use").isNotNull(), F.col("low")).alias("width"),
        F.when(F.col("use").isNotNull(), "complete")
        .when(F.col("unclosed"), "unclosed quote")
        .when(F.col("head").isNull(), "empty")
        .otherwise("malformed")
        .alias("status"),
        F.struct(F.col("head.block"), F.col("head.id")).alias("head"),
    )
    return Scan(records, checkpointed(spark, status))


def _fields(record: Column, sep: str, width: int) -> Column:
    schema = ", ".join(f"c{n} string" for n in range(width))
    options = {
        "sep": sep, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
        "maxColumns": str(max(width + 1, MAX_COLUMNS)),
    }
    # The array of one binds the parsed record to a name, so that it is parsed once.
    return F.transform(F.array(F.from_csv(record, schema, options)), lambda parsed: F.array(*[parsed[f"c{n}"] for n in range(width)]))[0]


def duplicate_headers(headers: DataFrame) -> DataFrame:
    """``headers(file, pos, label)`` -> labels used twice, with their 1-based places."""
    return (
        headers.groupBy("file", "label")
        .agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
        .filter("n > 1")
    )


def header_labels(status: DataFrame) -> DataFrame:
    """``[file, pos, label]`` of every readable file, 1-based."""
    shapes = status.filter("status = 'complete'").select("sep", "width").distinct().collect()
    parts = [
        status.filter((F.col("status") == "complete") & (F.col("sep") == s.sep) & (F.col("width") == s.width))
        .select("file", F.posexplode(_fields(F.col("header"), s.sep, s.width)).alias("pos", "label"))
        .select("file", (F.col("pos") + 1).alias("pos"), F.coalesce("label", F.lit("")).alias("label"))
        for s in shapes
    ]
    if not parts:
        spark = status.sparkSession
        return spark.createDataFrame([], "file string, pos int, label string")
    return reduce(DataFrame.unionByName, parts)


def read_cells(spark: SparkSession, path: str | list[str], sep: str | None = None, names: str = "*", files: DataFrame | None = None):
    """``(cells, status)`` of files with any mixture of headers, as one job.

    ``cells[dataset, pos, column, text, tag, _row]``; the dataset of a cell is
    its file. Rows without any content are dropped and empty cells are NULL.
    ``files`` are those of :func:`scan`.
    """
    found = scan(spark, path, sep, names, files)
    labels = header_labels(found.status)
    doubled = duplicate_headers(labels).select("file").distinct().withColumn("_twice", F.lit(True))
    status = found.status.join(doubled, "file", "left").withColumn(
        "status", F.when(F.col("_twice"), "duplicate header").otherwise(F.col("status"))
    ).drop("_twice")
    good = status.filter("status = 'complete'").select("file", F.col("sep").alias("use"), "width", "head")
    names = labels.groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("names")
    )
    rows = found.records.join(small(checkpointed(spark, good.join(names, "file"))), "file")
    rows = rows.filter(F.struct("block", "id") != F.col("head"))
    shapes = good.groupBy("use").agg(F.max("width").alias("width")).collect()
    if not shapes:
        row = "struct<block:bigint,id:bigint>"
        empty = f"dataset string, pos int, column string, text string, tag string, {ROW} {row}"
        return spark.createDataFrame([], empty), status
    # Files of all separators in one reading.
    record, values, blank = F.col("record"), F.lit(None), F.lit(None)
    for shape in shapes:
        own = F.col("use") == shape.use
        values = F.when(own, F.slice(_fields(record, shape.use, shape.width), F.lit(1), F.col("width"))).otherwise(values)
        blank = F.when(own, _is_blank_record(record, shape.use)).otherwise(blank)
    cells = rows.filter(~blank).select(
        F.col("file").alias("dataset"),
        F.struct("block", "id").alias(ROW),
        "names",
        F.posexplode(values).alias("pos", "text"),
    ).select(
        "dataset",
        "pos",
        F.get("names", F.col("pos")).alias("column"),
        "text",
        F.when(F.col("text").isNull(), "null").otherwise("str").alias("tag"),
        ROW,
    )
    return cells, status


def read_delimited(spark: SparkSession, path: str | list[str], sep: str | None = None, found: Scan | None = None):
    """``(df, status)`` of files that share one header, as a wide table of texts.

    A ``found`` scan of the files is not repeated.

    The files of one dataset are usually the parts of one export. Files with
    different headers are several datasets: use :func:`read_cells` for those.
    """
    found = scan(spark, path, sep) if found is None else found
    complete = found.status.filter("status = 'complete'")
    # A part with nothing but its header says little about the separator.
    filled = complete.filter("n_rows > 0")
    if not filled.isEmpty():
        complete = filled
    shapes = complete.select("sep", "width", "header").distinct().take(2)
    if len(shapes) != 1:
        if shapes:
            raise ValueError(f"files with different headers below {path}")
        bad = found.status.filter("status IN ('malformed', 'unclosed quote')").first()
        if bad is not None:
            raise ValueError(f"{bad.file} has no constant row width ({bad.status})")
        raise LookupError(f"no tabular content below {path}")
    shape = shapes[0]
    labels = header_labels(complete).select("pos", "label").distinct().orderBy("pos")
    names = [row.label for row in labels.collect()]
    _require_distinct(names)
    rows = found.records.join(small(complete.select("file", "head")), "file").filter(
        (F.struct("block", "id") != F.col("head")) & ~_is_blank_record(F.col("record"), shape.sep)
    )
    values = _fields(F.col("record"), shape.sep, shape.width)
    parsed = rows.select(values.alias("_v"), F.struct("block", "id").alias(ROW))
    df = parsed.select(*[F.get("_v", F.lit(n)).alias(name) for n, name in enumerate(names)], ROW)
    return df, found.status


def _require_distinct(names: list[str]) -> None:
    seen: dict[str, int] = {}
    for place, name in enumerate(names, 1):
        if name in seen:
            raise ValueError(f"duplicate header {name!r} at columns {seen[name]} and {place}")
        seen[name] = place
