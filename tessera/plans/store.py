"""Source-owned tables with an all-or-nothing catalog.

Layout below a store root::

    data/<table>/c=<commit>/*.parquet     rows of one table at one commit
    data/many/c=<commit>/*.parquet        rows of tables that one job wrote, in their order
    catalog/c=<commit>/{sources,tables}   the whole catalog after that commit
    commits/<number>                      one small file per commit

A commit becomes visible when its numbered file appears. The file is written
aside and renamed into place without overwriting, so of two writers that race
for a number one fails and nothing half-written can be read. Readers resolve
tables only through the newest commit; a failed run leaves unreferenced files.
"""
from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.naming import PROVENANCE, RESERVED, distinct_names, identifier, unique_identifiers
from tessera.functions.normalize import SPARK_TYPES, typed
from tessera.functions.temporal import with_moments
from tessera.operators.cells import ROW, as_text, melt, with_row
from tessera.operators.profile import first_rows, nulled_examples, profile
from tessera.session import checkpointed, filesystem, hadoop_path, spread
from tessera.sources.files import combined_checksum, is_contained

SOURCES = (
    "source_id string, source_resource string, summary_page string, content_checksum string, "
    "ingested_at timestamp_ntz, extraction_status string"
)
TABLES = (
    "table_name string, source_id string, dataset_name string, schema_json string, "
    "row_count bigint, updated_at timestamp_ntz, location string"
)


@dataclass
class Dataset:
    """A logical table before it is stored: texts or typed columns in source order.

    ``cells`` holds the same table in long form where cells of one column may
    have different native types; kinds and types are then decided from it.
    """

    name: str
    df: DataFrame
    source_page: int | None = None
    source_section: str | None = None
    source_sheet: str | None = None
    formula_columns: tuple[str, ...] = ()
    cells: DataFrame | None = None
    #: What is known of calculated columns, one entry each; they are inspected, never stored.
    formulas: list[dict] = field(default_factory=list)


@dataclass
class Manifest:
    """What one stored table looks like."""

    table_name: str
    dataset_name: str
    row_count: int
    columns: list[tuple[str, str]]
    sample: list[dict] = field(default_factory=list)
    normalizations: list[dict] = field(default_factory=list)


# --- commits ---------------------------------------------------------------


def _commits(spark: SparkSession, root: str) -> list[int]:
    fs, folder = filesystem(spark, root), hadoop_path(spark, f"{root}/commits")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(name) for name in names if name.isdigit())


def current(spark: SparkSession, root: str) -> dict | None:
    """The newest commit, or None for a store nobody has written to."""
    commits = _commits(spark, root)
    if not commits:
        return None
    stream = filesystem(spark, root).open(hadoop_path(spark, f"{root}/commits/{commits[-1]:012d}"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, root: str, number: int, entry: dict) -> None:
    fs = filesystem(spark, root)
    aside = hadoop_path(spark, f"{root}/commits/.{number:012d}.{uuid.uuid4().hex}")
    final = hadoop_path(spark, f"{root}/commits/{number:012d}")
    stream = fs.create(aside, False)
    stream.write(bytearray(json.dumps(entry, sort_keys=True).encode("utf-8")))
    stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = none
    context.rename(aside, final, options)


# --- reading ---------------------------------------------------------------


def catalog(spark: SparkSession, root: str, which: str) -> DataFrame:
    """The ``sources`` or ``tables`` registry as of the newest commit."""
    return catalog_at(spark, root, which, current(spark, root))


def catalog_at(spark: SparkSession, root: str, which: str, entry: dict | None) -> DataFrame:
    """The same as of a commit that ``current`` returned."""
    schema = {"sources": SOURCES, "tables": TABLES}[which]
    if entry is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{entry['catalog']}/{which}")


#: Between the folder that tables share and the name of one of them, in a location. Rows
#: hold it in a column ``table``, or, as earlier versions wrote them, in a folder of that name.
TABLE = "/table="


def stored_rows(spark: SparkSession, root: str, location: str, schema_json: str) -> DataFrame:
    """The rows of a table as its catalog entry describes them.

    A column lies under its own name or under that of a ``slot``, or is a
    ``constant`` of one ``value`` for all rows. A location that shares its folder and
    names no table has the rows of all, with the names as ``_table``.
    """
    columns = json.loads(schema_json)
    folder, shared, name = location.rpartition(TABLE) if TABLE in location else (location, "", "")
    read = [f"`{c.get('slot', c['name'])}` {SPARK_TYPES[c['type']]}" for c in columns if "constant" not in c]
    rows = spark.read.schema(", ".join(read + ["`table` string"] * bool(shared))).parquet(f"{root}/{folder}")
    if name:
        rows = rows.where(F.col("table") == name)
    return rows.select(
        *([F.col("table").alias("_table")] if shared and not name else []),
        *(
            (F.lit(c.get("value")).cast(SPARK_TYPES[c["type"]]) if "constant" in c else F.col(f"`{c.get('slot', c['name'])}`")).alias(c["name"])
            for c in columns
        )
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    found = catalog(spark, root, "tables").filter(F.col("table_name") == name).first()
    if found is None:
        raise LookupError(f"no table {name!r} in {root}")
    return stored_rows(spark, root, found.location, found.schema_json)


def owned_tables(spark: SparkSession, root: str, source_id: str) -> DataFrame:
    return catalog(spark, root, "tables").filter(F.col("source_id") == source_id)


# --- writing ---------------------------------------------------------------


def persist_source(spark, root, source_id, resource, summary_page, datasets, **options) -> list[Manifest]:
    """Store a new source; an id that is already cataloged is an error."""
    return _persist(spark, root, source_id, resource, summary_page, datasets, False, **options)


def rebuild_source(spark, root, source_id, resource, summary_page, datasets, **options) -> list[Manifest]:
    """Replace all tables of a known source and nothing else."""
    return _persist(spark, root, source_id, resource, summary_page, datasets, True, **options)


def _resource_checksum(spark: SparkSession, resource: str, raw_root: str | None) -> str:
    if raw_root is not None:
        inside = spark.range(1).select(is_contained(F.lit(resource), raw_root).alias("ok")).first().ok
        if not inside:
            raise ValueError(f"{resource} does not lie below the raw folder {raw_root}")
    n_files, checksum = combined_checksum(spark, resource)
    if n_files == 0:
        raise FileNotFoundError(f"nothing to read at {resource}")
    return checksum


def _persist(
    spark: SparkSession,
    root: str,
    source_id: str,
    resource: str,
    summary_page: str,
    datasets: list[Dataset],
    rebuild: bool,
    *,
    checksum: str | None = None,
    raw_root: str | None = None,
    kinds: dict[str, list[tuple[str, str | None]]] | None = None,
    sample: bool = True,
) -> list[Manifest]:
    """``kinds`` pins ``[(type, kind)]`` per dataset instead of detecting them; ``sample`` shows first rows in the manifests."""
    if not source_id:
        raise ValueError("a source needs a non-empty id")
    before = current(spark, root)
    sources, tables = (catalog_at(spark, root, which, before) for which in ("sources", "tables"))
    known = not sources.filter(F.col("source_id") == source_id).isEmpty()
    if known and not rebuild:
        raise ValueError(f"{source_id!r} is cataloged already; rebuild_source replaces a source")
    if rebuild and not known:
        raise ValueError(f"{source_id!r} is not in the catalog; persist_source adds a source")
    if checksum is None:
        checksum = _resource_checksum(spark, resource, raw_root)

    token = new_token(spark, root)
    others = tables.filter(F.col("source_id") != source_id)
    prefix = f"{identifier(source_id)}__"
    taken = [r.table_name for r in others.filter(F.col("table_name").startswith(prefix)).collect()]
    names = distinct_names([prefix + identifier(d.name) for d in datasets], taken)
    numbered = [with_row(dataset.df) for dataset in datasets]
    frames = [spread(df) for df in numbered]
    decided = _decide(spark, source_id, datasets, frames, kinds or {})
    manifests, rows = [], []
    for name, dataset, df, first, decision in zip(names, datasets, frames, numbered, decided):
        location = f"data/{name}/c={token}"
        manifest = _write(spark, f"{root}/{location}", name, source_id, dataset, df, decision, first if sample else None)
        manifests.append(manifest)
        schema_json = json.dumps([{"name": n, "type": t} for n, t in manifest.columns])
        rows.append((name, source_id, dataset.name, schema_json, manifest.row_count, location))

    now = F.current_timestamp().cast("timestamp_ntz")
    added = spark.createDataFrame(
        rows, "table_name string, source_id string, dataset_name string, schema_json string, "
        "row_count bigint, location string"
    ).withColumn("updated_at", now)
    source = spark.createDataFrame(
        [(source_id, resource, summary_page, checksum, "complete")],
        "source_id string, source_resource string, summary_page string, content_checksum string, "
        "extraction_status string",
    ).withColumn("ingested_at", now)
    commit(spark, root, added, source, before)
    return manifests


def new_token(spark: SparkSession, root: str) -> str:
    """Names a folder of data nobody else writes to."""
    return f"{(_commits(spark, root) or [0])[-1] + 1:012d}-{uuid.uuid4().hex[:8]}"


def _owned_state(spark: SparkSession, root: str, ids: DataFrame, entry: dict | None) -> list[tuple]:
    """What a commit knows of the sources ``ids``, in a few numbers."""
    known = {"sources": "content_checksum", "tables": "location"}
    mine = {which: catalog_at(spark, root, which, entry).join(ids, "source_id", "left_semi") for which in known}
    return [tuple(mine[which].agg(F.count("*"), F.sum(F.xxhash64("source_id", column).cast("decimal(38,0)"))).first()) for which, column in known.items()]


def commit(spark: SparkSession, root: str, added: DataFrame, source: DataFrame, before: dict | None) -> None:
    """Publish tables and their sources in place of all that these sources had, in one catalog.

    ``before`` is the commit that was the newest when the tables were named. What
    other writers did to other sources since then is taken over.
    """
    ids = source.select("source_id")
    while True:
        now = current(spark, root)
        number = (now["number"] if now else 0) + 1
        others = catalog_at(spark, root, "tables", now).join(ids, "source_id", "left_anti")
        if now != before:
            if _owned_state(spark, root, ids, now) != _owned_state(spark, root, ids, before):
                raise RuntimeError(f"another writer stored {source.first().source_id!r} meanwhile")
            if not others.join(added, "table_name", "left_semi").isEmpty():
                raise RuntimeError(f"another writer took a table name of {source.first().source_id!r} meanwhile")
        where = f"catalog/c={number:012d}-{uuid.uuid4().hex[:8]}"
        others.unionByName(added).write.parquet(f"{root}/{where}/tables")
        catalog_at(spark, root, "sources", now).join(ids, "source_id", "left_anti").unionByName(source).write.parquet(f"{root}/{where}/sources")
        try:
            return _publish(spark, root, number, {"number": number, "catalog": where, "source_id": source.first().source_id})
        except Py4JJavaError as error:
            # Another writer was first; the data stays as written.
            if not error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise


def stored_columns(dataset: Dataset) -> list[str]:
    return [n for n in dataset.df.columns if n != ROW and n not in dataset.formula_columns]


@dataclass
class _Decision:
    """What a dataset's columns become: ``(type, kind)`` each, and what was counted."""

    columns: list[tuple[str, str | None]]
    row_count: int | None = None
    normalizations: list[dict] = field(default_factory=list)


# Datasets profiled by one job; a source with more takes several jobs.
PROFILED_TOGETHER = 64


def _decide(spark, source_id, datasets, frames, pinned) -> list[_Decision]:
    """Kinds and types of all datasets, many per job, before anything is written."""
    found: dict[int, _Decision] = {}
    open_ones = []
    for n, dataset in enumerate(datasets):
        if dataset.name in pinned:
            found[n] = _Decision(pinned[dataset.name])
        else:
            open_ones.append(n)
    for start in range(0, len(open_ones), PROFILED_TOGETHER):
        batch = open_ones[start : start + PROFILED_TOGETHER]
        cells = [_cells(datasets[n], frames[n], str(n)).select("dataset", "column", "text", "tag") for n in batch]
        # One row per column: small whatever the size of the datasets.
        facts = checkpointed(spark, profile(reduce(DataFrame.unionByName, cells)))
        by_column = {(row.dataset, row.column): row for row in facts.collect()}
        too_big = [column for (_, column), row in by_column.items() if row.overflow]
        if too_big:
            raise RuntimeError(f"nothing of {source_id!r} was stored: {too_big} hold whole numbers beyond 64 bits")
        for n in batch:
            columns = stored_columns(datasets[n])
            rows = {c: by_column[str(n), c] for c in columns if (str(n), c) in by_column}
            found[n] = _Decision(
                [(rows[c].type, rows[c].kind) if c in rows else ("VARCHAR", None) for c in columns],
                max((row.row_count for row in rows.values()), default=0 if columns else None),
                _normalizations(datasets[n], frames[n], str(n), facts, rows),
            )
    return [found[n] for n in range(len(datasets))]


def _cells(dataset: Dataset, df: DataFrame, label: str, columns: list[str] | None = None) -> DataFrame:
    columns = stored_columns(dataset) if columns is None else columns
    if dataset.cells is None:
        return melt(df, columns, label)
    return dataset.cells.filter(F.col("column").isin(columns)).withColumn("dataset", F.lit(label))


def _normalizations(dataset: Dataset, df: DataFrame, label: str, facts: DataFrame, rows: dict) -> list[dict]:
    normalized = {column: row for column, row in rows.items() if row.kind is not None}
    examples: dict[str, list[str]] = {}
    # Only columns that lost something are read again, for examples.
    lossy = [column for column, row in normalized.items() if row.nulled]
    if lossy:
        own = facts.filter(F.col("dataset") == label)
        for row in nulled_examples(_cells(dataset, df, label, lossy), own).orderBy("rank").collect():
            examples.setdefault(row.column, []).append(row.example)
    return [
        {
            "column": column,
            "kind": row.kind,
            "type": row.type,
            "normalized": row.normalized,
            "nulled": row.nulled,
            "nulled_examples": examples.get(column, []),
        }
        for column, row in normalized.items()
    ]


def _write(spark, path, name, source_id, dataset: Dataset, df: DataFrame, decision: _Decision, shown: DataFrame | None) -> Manifest:
    columns = stored_columns(dataset)
    physical = unique_identifiers(columns)
    decided = decision.columns

    def stored(rows: DataFrame) -> DataFrame:
        typed_rows = typed_table(rows, columns, physical, decided)
        return append_provenance(
            typed_rows, source_id, dataset.source_page, dataset.source_section, dataset.source_sheet
        )

    stored(df).drop(ROW).write.parquet(path)
    schema = [*zip(physical, [t for t, _ in decided]), *PROVENANCE]
    # The sample is cut from the raw rows where they are read, so only its own rows move and are converted again.
    sample = [] if shown is None else [row.asDict() for row in stored(first_rows(shown)).orderBy(ROW).drop(ROW).collect()]
    row_count = decision.row_count
    if row_count is None:
        row_count = spark.read.parquet(path).count()
    return Manifest(name, dataset.name, row_count, schema, sample, decision.normalizations)


def typed_table(df: DataFrame, columns, physical, decided) -> DataFrame:
    """Texts to typed columns in one projection; temporal texts are parsed once each."""
    texts = {c: as_text(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns}
    temporal = {
        f"_ts_{p}": texts[c] for c, p, (_, kind) in zip(columns, physical, decided) if kind in ("date", "timestamp")
    }
    staged = with_moments(df, temporal) if temporal else df
    out = []
    for column, name, (type_name, kind) in zip(columns, physical, decided):
        if kind == "date":
            value = F.col(f"_ts_{name}.ts").cast("date")
        elif kind == "timestamp":
            value = F.col(f"_ts_{name}.ts")
        else:
            value = typed(texts[column], type_name, kind)
        out.append(value.alias(name))
    return staged.select(ROW, *out)


def append_provenance(df: DataFrame, source_id: str, page=None, section=None, sheet=None) -> DataFrame:
    if not source_id:
        raise ValueError("a source needs a non-empty id")
    values = (source_id, page, section, sheet)
    return df.withColumns(
        {n: F.lit(v).cast(SPARK_TYPES[t]) for (n, t), v in zip(PROVENANCE, values)}
    )


def citations(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of a table with the summary page and resource they can be cited by."""
    owner = catalog(spark, root, "tables").filter(F.col("table_name") == name).select("source_id")
    # A table belongs to one source: its one catalog row becomes literals, and no row moves.
    cited = catalog(spark, root, "sources").join(owner, "source_id", "left_semi").first()
    found = table(spark, root, name)
    values = {c: F.lit(cited[c] if cited else None).cast("string") for c in ("summary_page", "source_resource")}
    return found.select("source_id", *(c for c in found.columns if c != "source_id"), *(v.alias(c) for c, v in values.items()))


def source_inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row per table for a source summary: status, schema and row count."""
    sources = catalog(spark, root, "sources").select("source_id", "summary_page", "extraction_status")
    tables = catalog(spark, root, "tables").select("source_id", "table_name", "dataset_name", "schema_json", "row_count")
    return sources.join(tables, "source_id", "left")


def vacuum(spark: SparkSession, root: str, min_age_hours: float = 24 * 7) -> int:
    """Remove table versions and catalogs the newest commit no longer refers to.

    Younger folders stay: a running writer may not have committed them yet, and
    a reader may still be on the version before.
    """
    before = (time.time() - 3600 * min_age_hours) * 1000
    commit = current(spark, root)
    if commit is None:
        return 0
    fs = filesystem(spark, root)
    folder = F.substring_index("location", "/", 3)  # tables that were written together go together
    live = {row.folder for row in catalog(spark, root, "tables").select(folder.alias("folder")).distinct().collect()}
    live.add(commit["catalog"])
    removed = 0
    for status in fs.globStatus(hadoop_path(spark, f"{root}/data/*/c=*")):
        location = "/".join(["data", *status.getPath().toString().rsplit("/", 2)[-2:]])
        if location not in live and status.getModificationTime() <= before:
            fs.delete(status.getPath(), True)
            removed += 1
    for status in fs.globStatus(hadoop_path(spark, f"{root}/catalog/c=*")):
        if f"catalog/{status.getPath().getName()}" not in live and status.getModificationTime() <= before:
            fs.delete(status.getPath(), True)
            removed += 1
    return removed
