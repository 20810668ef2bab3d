"""Arrow helpers the text operators share."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tessera.session import filesystem, hadoop_path, scratch

#: Bytes of text worked on at once by one task.
PORTION = 4 << 20

#: Words are runs of anything but space and the control characters 9 to 13;
#: ``bytes.split`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def portions(batches: Iterator[pa.RecordBatch], column: str, limit: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def per_portion(
    df: DataFrame,
    schema: str | StructType,
    work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    column: str = "text",
) -> DataFrame:
    """Apply a function to bounded slices of rows.

    ``work()`` runs once in each task and may load a model there; what it
    returns gets one slice after the other.
    """

    def run(batches):
        step = work()
        for portion in portions(batches, column):
            yield step(portion)

    return df.mapInArrow(run, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that nothing before it is needed again.

    A lost executor costs no earlier step, and the shuffle files of the steps
    before go as soon as the table is complete.
    """
    spark = df.sparkSession
    path, key = scratch(spark, label), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Remove tables of ``written`` whose every use has been written itself."""
    for table in tables:
        path = table.written_to
        filesystem(table.sparkSession, path).delete(hadoop_path(table.sparkSession, path), True)


#: A run of word starts with what follows up to the next one.
RUNS = re.compile("▁+[^▁]*")
