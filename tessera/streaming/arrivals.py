"""Streams over a raw landing area, run to the end of what has arrived."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.plans.store import Dataset, catalog, persist_source, rebuild_source
from tessera.session import checkpointed, filesystem, hadoop_path
from tessera.sources.delimited import Scan, header_labels, read_delimited, scan
from tessera.sources.files import file_checksums, reader_for

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
ARRIVED = "path string, length bigint, checksum string, status string"

#: Files of a micro-batch at most; their paths and statuses pass through the driver.
FILES_PER_BATCH = 1000
def _arrivals(spark: SparkSession, raw: str) -> DataFrame:
    """Paths and lengths of arriving files; their contents are not read."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
        .load(raw)
    )
    return files.select("path", "length")


def literal(path: str) -> str:
    """A path that is not taken for a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _checked(batch: DataFrame) -> DataFrame:
    """``[path, length, checksum, status]`` of the files of a batch; every size is hashed alike."""
    status = (
        F.when(reader_for(F.col("path")) == "unsupported", "unsupported")
        .when(F.col("length") == 0, "empty")
        .otherwise("pending")
    )
    return file_checksums(batch).withColumn("status", status)


def raw_arrivals(spark: SparkSession, raw: str, out: str, checkpoint: str) -> DataFrame:
    """New files below ``raw`` -> ``[path, length, checksum, status, batch]`` below ``out``.

    Every micro-batch overwrites its own folder, so a batch that is replayed
    after a failure leaves one copy. The sink is what a later run appends to.
    """

    def save(batch: DataFrame, number: int) -> None:
        # One small file for each batch, hashed before by many tasks.
        _checked(batch).repartition(1).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _drain(_arrivals(spark, raw), save, checkpoint)
    return spark.read.schema(f"{ARRIVED}, batch bigint").option("basePath", out).parquet(out)


def _known(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first pending file with a checksum stays so, all later ones are duplicates; the state is whether there was one."""
    files = pd.concat(list(frames)).sort_values("path", kind="stable")
    pending = files["status"] == "pending"
    later = pending & (state.exists | (pending.cumsum() > 1))
    if pending.any() and not state.exists:
        state.update((True,))
    yield files.assign(status=files["status"].mask(later, "duplicate"))


def new_contents(spark: SparkSession, arrived: str) -> DataFrame:
    """A stream of arrivals saved by ``raw_arrivals`` in which contents seen before are ``duplicate``.

    Checksums are the keys of the stream's state, so what a batch costs does not
    depend on how much arrived before, and a replayed batch meets the state it met
    the first time.
    """
    files = spark.readStream.schema(ARRIVED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(arrived)
    return files.groupBy("checksum").applyInPandasWithState(_known, ARRIVED, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def normalize_upsert(
    spark: SparkSession,
    raw: str,
    schema: str,
    root: str,
    source_id: str,
    kinds: list[tuple[str, str | None]],
    checkpoint: str,
    sep: str | None = None,
) -> DataFrame:
    """Normalize arriving delimited files with pinned kinds; one owned source per batch.

    Files go through the scanner with all its checks. Only those with the columns
    of ``schema`` are stored; each file gets a row ``[path, checksum, status,
    n_rows, batch]``, and one with a content that arrived before is a
    ``duplicate``. A batch is stored under ``<source_id>-<batch>``; replaying it
    rebuilds exactly that source, and earlier batches are never rewritten.

    Two streams: one hashes what arrives, the other tells what is new by its own
    state and stores that.
    """
    statuses, found = f"{root}/arrivals/{source_id}", f"{root}/arrivals/{source_id}-found"
    row = "path string, checksum string, status string, n_rows bigint, batch bigint"
    names = T.StructType.fromDDL(schema).names

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.select("path", "checksum", "status").collect()  # FILES_PER_BATCH at most
        pending = [literal(r.path) for r in rows if r.status == "pending"]
        scanned = {}
        if pending:
            shape = scan(spark, pending, sep)
            labels = header_labels(shape.status).groupBy("file").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("labels")
            )
            same = F.coalesce(F.col("labels") == F.lit(names), F.lit(False))
            verdict = F.when(F.col("status") != "complete", F.col("status")).when(same, "stored").otherwise("other header")
            judged = checkpointed(spark, shape.status.join(labels, "file", "left").select("file", "n_rows", verdict.alias("verdict")))
            scanned = {r.file: r for r in judged.collect()}
            good = shape.status.join(judged.filter("verdict = 'stored'").select("file"), "file", "left_semi")
            if any(r.verdict == "stored" for r in scanned.values()):
                df, _ = read_delimited(spark, pending, sep, Scan(shape.records, good))
                digest = hashlib.sha256("\n".join(sorted(r.checksum for r in rows if r.path in scanned)).encode()).hexdigest()
                name = f"{source_id}-{number}"
                known = not catalog(spark, root, "sources").filter(F.col("source_id") == name).isEmpty()
                store = rebuild_source if known else persist_source
                store(
                    spark, root, name, raw, f"wiki/sources/{source_id}.md", [Dataset("rows", df)],
                    checksum=digest, kinds={"rows": kinds}, sample=False,
                )
        lines = [(r.path, r.checksum, scanned[r.path].verdict if r.path in scanned else r.status, scanned[r.path].n_rows if r.path in scanned else 0) for r in rows]
        spark.createDataFrame(lines, row.rpartition(",")[0]).write.mode("overwrite").parquet(f"{statuses}/batch={number}")

    raw_arrivals(spark, raw, found, f"{checkpoint}/found")
    if filesystem(spark, found).exists(hadoop_path(spark, found)):
        _drain(new_contents(spark, found), save, f"{checkpoint}/stored")
    return spark.read.schema(row).option("basePath", statuses).parquet(statuses)


def _drain(rows: DataFrame, save, checkpoint: str) -> None:
    query = (
        rows.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
