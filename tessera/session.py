"""Session settings and scratch space shared by the jobs."""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

REQUIRED = {
    # Naive timestamps are compared and printed in UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode. Stages that
    # would need one run through smaller generated functions instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: str | int = "*", app: str = "tessera") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.openCostInBytes", "1048576")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the results depend on to a session made elsewhere."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a session whose executor is the driver itself may fall back to a
    machine-local folder; a cluster (``local-cluster`` too) without the setting
    is an error, because executors would write to disks the driver never sees.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = os.path.join(tempfile.gettempdir(), "tessera-scratch")
    return configured.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    hadoop = filesystem(spark, path)
    handle = hadoop_path(spark, path)
    hadoop.mkdirs(handle)
    hadoop.deleteOnExit(handle)
    return path


def checkpointed(spark: SparkSession, df):
    """Cut lineage through reliable storage, so that lost executors are harmless."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def small(df, rows: int = 100_000, size: int = 64 << 20):
    """A broadcast hint for a materialized side, if rows and bytes show it is small.

    Meant for checkpointed facts (one row per column, sheet or file). Beyond a
    limit the join is left to the optimizer, which shuffles and splits skew.
    Bytes are counted as text, so that long arrays in few rows are seen too.
    """
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and found["size"] <= size else df


def spread(df):
    """Use all cores for costly work on an input that comes in a few splits.

    A large input already has more splits than there are cores and is returned
    as it is; only one that would fit into a split per core is redistributed.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if int(str(size)) < cores * int(split) else df


def dealt(df, *keys: str):
    """Rows dealt out by ``keys`` over more tasks than there are cores, however few bytes they are.

    For work whose time is in the number of rows, such as a file to open for each.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


#: Files of a folder are listed by so many tasks per core, and count as so many bytes when they are dealt out.
LISTED_BY, OPEN_COST = 8, 1 << 14


def reading(spark: SparkSession, split: int | None = None) -> SparkSession:
    """A session to read folders with many small files, and with the files cut into the same splits by every job.

    Places in a file are told by split and row, in several jobs; settings that
    change in between, or executors that come and go, must not move them. Splits
    have ``split`` bytes at most.
    """
    pinned = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    cores = spark.sparkContext.defaultParallelism
    least = "spark.sql.files.minPartitionNum"
    pinned.conf.set(least, spark.conf.get(least, None) or cores)
    pinned.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTED_BY * cores)
    conf = spark._jsparkSession.sessionState().conf()
    # Each frame lists its own files; what it found is of no use to another and need not stay when it is gone.
    pinned.conf.set("spark.sql.hive.filesourcePartitionFileCacheSize", 0)
    pinned.conf.set("spark.sql.files.openCostInBytes", min(int(conf.filesOpenCostInBytes()), OPEN_COST))
    pinned.conf.set("spark.sql.files.maxPartitionBytes", min(int(conf.filesMaxPartitionBytes()), split or 1 << 62))
    return pinned


def counted(spark: SparkSession) -> SparkSession:
    """A session that broadcasts a side of a join only by the bytes it turned out to have.

    What the optimizer expects follows the bytes of compressed files, and knows nothing of
    rows that were taken apart since: a small file may become more than a driver holds.
    Frames made from this session, and joins that have such a frame on their left, keep to it.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    limit, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    own.conf.set(measured, spark.conf.get(measured, None) or spark.conf.get(limit))
    own.conf.set(limit, -1)
    return own


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def filesystem(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
