"""Many tables of many sources in one write and one commit.

All datasets come as long cells. One job packs the cells of a row that lie together,
one profiles them, one deals the packed rows out and writes all tables into one
folder, in the order of tables and rows, and one commit adds all sources to the
catalog, so neither the number of jobs nor that of files depends on how many datasets
there are. A table is read from the few files, and row groups of these, whose range of
tables holds it.

A table is stored in slots, typed columns named by type and number (``l1`` is a
table's second BIGINT), so tables of any shape share one write and stay typed:
columns are pruned and filters are pushed down as in a table of its own. The
catalog says which column lies in which slot, and holds the provenance of a table
once. A row's place in its source is kept in ``_row``.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.naming import PROVENANCE, RESERVED, sanitize, unique_names
from tessera.functions.normalize import SPARK_TYPES
from tessera.functions.temporal import iso_calendar_date, with_moments
from tessera.operators.cells import ROW
from tessera.operators.profile import normalized_text, nulled_examples, profile
from tessera.plans.store import TABLE, catalog, catalog_at, commit, current, new_token, stored_rows
from tessera.session import checkpointed, reading, scratch, small

#: Slot names by type.
SLOTS = {"BIGINT": "l", "DOUBLE": "f", "BOOLEAN": "b", "DATE": "d", "TIMESTAMP": "t", "VARCHAR": "s"}
LETTER_TYPES = {letter: type_ for type_, letter in SLOTS.items()}
DATASET = ["source_id", "dataset"]
#: What a packed row holds of each cell.
CELL = ["pos", "column", "text", "tag"]
#: Packed rows are written in row groups of so many bytes and read in a few splits per core, so that the rows of few tasks
#: keep all cores busy; large inputs in splits of so many bytes, as what is counted combines within a split. So many cells
#: are dealt out to a task, at least and at most: what a task sorts stays in memory.
GROUP, READ_BY, SPLIT = 1 << 20, 3, 64 << 20
FEWEST, MOST = 10_000, 2_000_000


def _stop(spark: SparkSession, wrong: DataFrame, column: str, why: str) -> None:
    """An error that names a few of the rows that should not be there."""
    few = [str(row[0]) for row in wrong.select(F.col(column).cast("string")).distinct().limit(4).collect()]
    if few:
        raise ValueError(f"nothing was stored: {', '.join(map(repr, few[:3]))}{' and others' if few[3:] else ''} {why}")


def _check_sources(spark, root, sources: DataFrame, entry: dict | None, rebuild: bool) -> None:
    _stop(spark, sources.where("source_id IS NULL OR source_id = ''"), "summary_page", "belong to a source without an id")
    _stop(spark, sources.groupBy("source_id").count().where("count > 1"), "source_id", "are listed twice")
    known = catalog_at(spark, root, "sources", entry).select("source_id")
    if rebuild:
        _stop(spark, sources.join(known, "source_id", "left_anti"), "source_id", "are not in the catalog")
    else:
        _stop(spark, sources.join(known, "source_id", "left_semi"), "source_id", "are cataloged already")


def _leaves(column: pa.Array) -> list[pa.Array]:
    return [leaf for field in column.flatten() for leaf in _leaves(field)] if pa.types.is_struct(column.type) else [column]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's work: cells of one row that follow one another become one record."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in (*DATASET, ROW)]
        begins = np.zeros(batch.num_rows, bool)
        begins[0] = True
        for leaf in (leaf for key in keys for leaf in _leaves(key)):
            begins[1:] |= ~pc.fill_null(pc.equal(leaf[1:], leaf[:-1]), False).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(begins)
        cells = pa.StructArray.from_arrays([batch.column(c) for c in CELL], CELL)
        lists = pa.ListArray.from_arrays(pa.array([*at, batch.num_rows], pa.int32()), cells)
        yield pa.RecordBatch.from_arrays([*(key.take(pa.array(at)) for key in keys), lists], [*DATASET, ROW, "cells"])


def _packed(spark, cells: DataFrame) -> DataFrame:
    """``source_id, dataset, _row, cells``: the cells, those of a row that lie together in one record, read from scratch files.

    A row whose cells lie apart stays in several records.
    """
    cells = cells.select(*DATASET, ROW, *CELL)
    one = T.StructType([T.StructField(c, cells.schema[c].dataType) for c in CELL])
    kept = T.StructType([*(T.StructField(c, cells.schema[c].dataType) for c in (*DATASET, ROW)), T.StructField("cells", T.ArrayType(one))])
    path = scratch(spark, "packed")
    cells.mapInArrow(_runs, kept).write.mode("overwrite").option("parquet.block.size", GROUP).parquet(path)
    pinned = reading(spark, SPLIT)
    pinned.conf.set("spark.sql.files.minPartitionNum", READ_BY * spark.sparkContext.defaultParallelism)
    return pinned.read.schema(kept).parquet(path)


def _columns(spark, cells: DataFrame) -> DataFrame:
    """What becomes of every column: ``source_id, dataset, pos, label, column, type, kind, slot`` and its counts."""
    labelled = cells.select(F.struct("source_id", "dataset", "pos").alias("dataset"), "column", "text", "tag")
    facts = checkpointed(spark, profile(labelled)).select("dataset.*", F.col("column").alias("label"), "type", "kind", "row_count", "normalized", "nulled", "overflow")
    _stop(spark, facts.where("overflow"), "label", "hold whole numbers beyond 64 bits")
    _stop(spark, facts.groupBy(*DATASET, "label").agg(F.count("*").alias("n")).where("n > 1"), "label", "name two columns of a dataset")
    named = unique_names(facts.withColumn("_slug", sanitize(F.col("label"))), DATASET, "_slug", "pos", RESERVED).withColumnRenamed("name", "column")
    letter = F.create_map(*(F.lit(x) for pair in SLOTS.items() for x in pair))[F.col("type")]
    # As many rows as one table has columns.
    nth = F.row_number().over(W.partitionBy(*DATASET, "type").orderBy("pos")) - 1
    return checkpointed(spark, named.drop("_slug", "overflow").withColumn("slot", F.concat(letter, nth.cast("string"))))


def _tables(spark, root, columns: DataFrame, sources: DataFrame, entry: dict | None) -> DataFrame:
    """``source_id, dataset, table_name, row_count``, names in the order of sources and datasets."""
    listed = columns.groupBy(*DATASET).agg(F.max("row_count").alias("row_count"))
    others = catalog_at(spark, root, "tables", entry).join(sources.select("source_id"), "source_id", "left_anti").select("table_name")
    base = F.concat_ws("__", sanitize(F.col("source_id")), sanitize(F.col("dataset")))
    named = unique_names(listed.withColumns({"_base": base, "_order": F.struct(*DATASET)}), [], "_base", "_order", others)
    return checkpointed(spark, named.select(*DATASET, F.col("name").alias("table_name"), "row_count"))


def _values(cells: DataFrame) -> DataFrame:
    """Cells with the value that their column's type makes of them, in a struct with a field for each slot letter."""
    text, kind, type_ = F.col("text"), F.col("kind"), F.col("type")
    temporal = kind.isin("date", "timestamp") | (type_ == "DATE")
    staged = with_moments(cells, {"_moment": F.when(temporal, text)})
    moment = F.col("_moment.ts")
    day = F.when(kind == "date", moment.cast("date")).otherwise(F.coalesce(iso_calendar_date(text), moment.cast("date")))
    value = {
        "BIGINT": F.when(type_ == "BIGINT", text.try_cast("bigint")),
        "DOUBLE": F.when(type_ == "DOUBLE", text.try_cast("double")),
        "BOOLEAN": F.when(type_ == "BOOLEAN", text.try_cast("boolean")),
        "DATE": F.when(type_ == "DATE", day),
        "TIMESTAMP": F.when(type_ == "TIMESTAMP", moment),
        "VARCHAR": F.when(type_ == "VARCHAR", F.when(kind.isNull(), text).otherwise(normalized_text(text, kind))),
    }
    return staged.withColumn("_value", F.struct(*(v.cast(SPARK_TYPES[t]).alias(SLOTS[t]) for t, v in value.items())))


def _write(spark, path: str, packed: DataFrame, columns: DataFrame, tables: DataFrame) -> None:
    # One row for each dataset. A cell is told its slot and kind in one short text, the slot tells the type.
    own = columns.where("pos IS NOT NULL").groupBy(*DATASET, "pos").agg(F.concat_ws(",", F.collect_list(F.concat_ws(" ", "slot", "kind"))).alias("to"))
    own = own.groupBy(*DATASET).agg(F.array_sort(F.collect_list(F.struct("pos", "to"))).alias("own"))
    own = own.join(tables, DATASET).select(*DATASET, "table_name", F.col("own.pos").alias("_pos"), F.col("own.to").alias("_to"))
    rows = packed.select(*DATASET, ROW, F.col("cells.pos").alias("pos"), F.col("cells.text").alias("text"))
    known = F.transform("pos", lambda p: F.try_element_at("_to", F.nullif(F.array_position("_pos", p), F.lit(0)).cast("int")))
    to = F.when(F.col("pos") == F.col("_pos"), F.col("_to")).otherwise(known)  # most rows hold all columns
    placed = rows.join(small(checkpointed(spark, own)), DATASET).select("table_name", ROW, to.alias("to"), "text")
    # One shuffle of packed rows: rows of a table lie together, those of a large one over many
    # tasks, and what is dealt out by ranges of (table, row) is grouped by them where it lies.
    # Ranges are sampled first, so texts become values only once they are dealt out.
    n_cells = columns.agg(F.sum("row_count")).first()[0]
    tasks = max(1, -(-n_cells // MOST), min(2 * spark.sparkContext.defaultParallelism, n_cells // FEWEST))
    dealt = placed.repartitionByRange(tasks, "table_name", ROW)
    cells = dealt.select("table_name", ROW, F.inline(F.arrays_zip("to", "text"))).select("table_name", ROW, F.explode(F.split("to", ",")).alias("to"), "text")
    slot, kind = F.split_part("to", F.lit(" "), F.lit(1)), F.split_part("to", F.lit(" "), F.lit(2))
    type_ = F.create_map(*(F.lit(x) for pair in LETTER_TYPES.items() for x in pair))[F.substring("to", 1, 1)]
    valued = _values(cells.select("table_name", ROW, "text", slot.alias("slot"), F.nullif(kind, F.lit("")).alias("kind"), type_.alias("type")))
    rows = valued.groupBy("table_name", ROW).agg(F.map_from_entries(F.collect_list(F.struct("slot", "_value"))).alias("_of"))
    widths = columns.groupBy(F.substring("slot", 1, 1).alias("letter")).agg(F.max(F.substring("slot", 2, 9).cast("int")).alias("last")).collect()
    slots = [(r.letter, n) for r in sorted(widths) for n in range(r.last + 1)]
    shaped = rows.select(F.col("table_name").alias("table"), ROW, *(F.try_element_at("_of", F.lit(f"{x}{n}"))[x].alias(f"{x}{n}") for x, n in slots))
    shaped.sortWithinPartitions("table", ROW).write.parquet(path)


def persist_many(spark: SparkSession, root: str, sources: DataFrame, cells: DataFrame, provenance: DataFrame | None = None, rebuild: bool = False) -> DataFrame:
    """Store all datasets of ``cells`` as tables of their ``sources``; all of them or none.

    ``sources`` (source_id, source_resource, summary_page, content_checksum) are
    new ones, or with ``rebuild`` known ones whose tables are replaced; those
    without cells are cataloged without a table. ``cells`` (source_id, dataset,
    pos, column, text, tag, _row) hold each cell of a row once. ``provenance``
    (source_id, dataset, source_page, source_section, source_sheet) may say where
    datasets come from. Returns a row for each stored column.
    """
    sources = checkpointed(spark, sources.select(*(F.col(c).cast("string").alias(c) for c in ("source_id", "source_resource", "summary_page", "content_checksum"))))
    before = current(spark, root)
    _check_sources(spark, root, sources, before, rebuild)
    packed = _packed(spark, cells)
    columns = _columns(spark, packed.select(*DATASET, F.inline("cells")))
    _stop(spark, columns.join(sources, "source_id", "left_anti"), "source_id", "hold cells and are not listed")
    tables = _tables(spark, root, columns, sources, before)
    location = f"data/many/c={new_token(spark, root)}"
    if not columns.isEmpty():
        _write(spark, f"{root}/{location}", packed, columns, tables)
    page, section, sheet = (name for name, _ in PROVENANCE[1:])
    if provenance is None:
        provenance = tables.select(*DATASET).withColumns({page: F.lit(None).cast("bigint"), section: F.lit(None).cast("string"), sheet: F.lit(None).cast("string")})
    def entry(name, type_, slot=None, value=None, constant=None):
        fields = {"name": name, "type": type_, "slot": slot, "value": value, "constant": constant}
        return F.struct(*((F.lit(None).cast("boolean" if n == "constant" else "string") if c is None else c).alias(n) for n, c in fields.items()))

    own = F.struct("pos", entry(F.col("column"), F.col("type"), F.col("slot")).alias("e"))
    listed = columns.groupBy(*DATASET).agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["e"]).alias("own"))
    known = provenance.select(*DATASET, F.col(page).cast("string").alias(page), section, sheet)
    stamped = F.array(*(entry(F.lit(n), F.lit(t), value=F.col(n), constant=F.lit(True)) for n, t in PROVENANCE))
    schema = F.to_json(F.concat("own", stamped))  # fields without a value are left out
    added = tables.join(listed, DATASET).join(known, DATASET, "left").select(
        "table_name",
        "source_id",
        F.col("dataset").alias("dataset_name"),
        schema.alias("schema_json"),
        "row_count",
        F.concat(F.lit(location + TABLE), "table_name").alias("location"),
    )
    now = F.current_timestamp().cast("timestamp_ntz")
    added = checkpointed(spark, added.withColumn("updated_at", now))
    commit(spark, root, added, sources.withColumns({"extraction_status": F.lit("complete"), "ingested_at": now}), before)
    return columns.join(tables.drop("row_count"), DATASET).select("table_name", *DATASET, "pos", "label", "column", "type", "kind", "row_count", "normalized", "nulled")


def together(spark: SparkSession, root: str, location: str, schema_json: str) -> DataFrame:
    """The rows of all tables that lie beside the one at ``location`` and have its shape, under ``table_name``."""
    rows = stored_rows(spark, root, location.rpartition(TABLE)[0] + TABLE, schema_json)
    return rows.withColumnRenamed("_table", "table_name")


def lost_examples(spark: SparkSession, cells: DataFrame, stored: DataFrame) -> DataFrame:
    """``source_id, dataset, label, rank, example``: the first texts of each stored column that became NULL."""
    labelled = cells.select(F.struct(*DATASET).alias("dataset"), "column", "text", "tag", ROW)
    kinds = stored.select(F.struct(*DATASET).alias("dataset"), F.col("label").alias("column"), "kind", "nulled")
    return nulled_examples(labelled, checkpointed(spark, kinds)).select("dataset.*", F.col("column").alias("label"), "rank", "example")


def many_first_rows(spark: SparkSession, root: str, names: DataFrame, n: int = 5) -> DataFrame:
    """``table_name, rank, row``: the first rows of stored tables that one job wrote, as JSON, in one pass.

    ``names`` has a column ``table_name``.
    """
    entries = catalog(spark, root, "tables").join(names.select("table_name").distinct(), "table_name", "left_semi")
    folder = F.substring_index("location", TABLE, 1)
    entries = checkpointed(spark, entries.select("table_name", folder.alias("folder"), "schema_json"))
    folders = [r.folder for r in entries.select("folder").distinct().collect()]  # one for each bulk write
    out = None
    for folder in folders:
        rows = spark.read.parquet(f"{root}/{folder}")
        slots = [c for c in rows.columns if c not in ("table", ROW)]
        rank = F.row_number().over(W.partitionBy("table").orderBy(ROW))
        first = rows.withColumn("rank", rank).where(F.col("rank") <= n)
        texts = F.map_from_arrays(F.array(*map(F.lit, slots)), F.array(*(F.col(c).cast("string") for c in slots))) if slots else F.create_map()
        mine = entries.where(F.col("folder") == folder).withColumn("columns", F.from_json("schema_json", "array<struct<name:string,slot:string>>"))
        kept = F.filter("columns", lambda c: c["slot"].isNotNull())
        row = F.map_from_entries(F.transform(kept, lambda c: F.struct(c["name"], F.try_element_at(F.col("_texts"), c["slot"]))))
        found = first.withColumn("_texts", texts).join(mine, F.col("table").cast("string") == F.col("table_name")).select("table_name", "rank", F.to_json(row, {"ignoreNullFields": "false"}).alias("row"))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "table_name string, rank int, row string") if out is None else out
