"""What is in the raw area: dispatch, containment and checksums."""
from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpointed, reading

# Extension -> reader.
READERS = {"csv": "delimited", "tsv": "delimited", "xlsx": "worksheet"}


def reader_for(path: Column) -> Column:
    """``delimited``, ``worksheet`` or ``unsupported``."""
    suffix = F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"\A.+[.]([^.]+)\z", 1))
    choice = F.lit(None).cast("string")
    for name, reader in READERS.items():
        choice = F.when(suffix == name, reader).otherwise(choice)
    return F.coalesce(choice, F.lit("unsupported"))


def default_separator(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".tsv"), "\t").otherwise(",")


SCHEME = r"\A([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?"


def resolved(path: Column) -> Column:
    """An absolute path with ``.``, ``..`` and doubled slashes worked out."""
    scheme = F.regexp_extract(path, SCHEME, 1)
    parts = F.filter(
        F.split(F.regexp_replace(path, SCHEME, ""), "/"), lambda part: ~part.isin("", ".")
    )
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(
            part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        ).otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(scheme, F.lit("/"), F.array_join(kept, "/"))


def is_contained(path: Column, raw_root: str) -> Column:
    """Only files strictly below the configured raw folder are accepted."""
    return resolved(path).startswith(raw_root.rstrip("/") + "/")


def source_path(column: str = "_metadata.file_path") -> Column:
    """The plain path of the file a row was read from; Spark keeps it percent-encoded."""
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))


#: Names of files that the delimited reader takes, as a pattern.
DELIMITED = "*.{[cC][sS][vV],[tT][sS][vV]}"


def listing(spark: SparkSession, path: str | list[str], names: str = "*") -> DataFrame:
    """Every file below ``path`` whose name fits the pattern ``names``; contents are not read, and empty files are not seen."""
    files = reading(spark).read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    return DataFrame(files._jdf, spark).select("path", "modificationTime", "length")


#: What Spark writes as ``%XX`` in a folder named after a value, and the name that stands for no value.
ESCAPED, NO_VALUE = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]"), "__HIVE_DEFAULT_PARTITION__"


def write_files(lines: DataFrame, path: str) -> int:
    """Write ``lines`` (name, extension, line) below ``path`` of a local file system, one file for each name and extension, and count the files.

    Lines of a file follow one another in one task. Files lie in ``name=`` folders, as Spark's
    writers put them; those start two processes for each file they make in a local file system.
    A file appears when it is whole, and a repeated task writes the same files again.
    """
    names = lines.select(F.nullif("name", F.lit("")).alias("name"), "extension", F.col("line").cast("binary").alias("line"))
    root = re.sub(SCHEME, "", path, count=1)
    os.makedirs(root, exist_ok=True)
    written = names.mapInArrow(_written(root, uuid.uuid4().hex), "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def _written(root: str, token: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("name", "extension", "line"))))
        for (name, extension), own in groupby(rows, lambda row: row[:2]):
            folder = f"{root}/name={NO_VALUE if name is None else ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', name)}"
            file = f"part-{task.partitionId():05d}-{token}.{extension}"
            os.makedirs(folder, exist_ok=True)
            with open(aside := f"{folder}/.{file}.{task.taskAttemptId()}", "wb") as out:
                out.writelines((line or b"") + b"\n" for *_, line in own)
            os.replace(aside, f"{folder}/{file}")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


#: Bytes of a range that is hashed at once, and hashes that are hashed together.
RANGE, FANOUT = 8 << 20, 1024


def checksums(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``[path, length, checksum]`` of every file below ``path``, whatever its size."""
    return file_checksums(listing(spark, path).select("path", "length"), RANGE, FANOUT)


def file_checksums(files: DataFrame, size: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """``[path, length, checksum]`` of the files listed in ``files`` (path, length).

    A tree of SHA-256 hashes: one for each range of ``size`` bytes, one for each
    ``fanout`` of these in order, and so on up to a single one. A file of one range
    has the plain hash of its bytes. Ranges are read by their place in the file, as
    tasks of their own, so a file of any size is spread and never held as a whole.
    """
    spark = files.sparkSession
    files = checkpointed(spark, files.select("path", "length").distinct())
    ranges, full = F.greatest(F.ceil(F.col("length") / size), F.lit(1)), F.floor(F.col("length") / size)
    found = files.agg(*(F.coalesce(c, F.lit(0)).alias(n) for n, c in (("ranges", F.sum(ranges)), ("full", F.sum(full)), ("most", F.max("length"))))).first()
    scheme = F.regexp_extract("path", SCHEME, 1)
    direct = [r.scheme for r in files.select(scheme.alias("scheme")).distinct().collect() if _opened(r.scheme) is not None]
    by_range = scheme.isin(*direct) if direct else F.lit(False)
    node = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)).cast("bigint"))).alias("node")
    # Few bytes name much work, so the number of tasks is not left to their size: 16 full ranges or 512 small files each.
    tasks = int(max(1, min(found.ranges, max(4 * spark.sparkContext.defaultParallelism, found.full // 16, found.ranges // 512))))
    parts = files.where(by_range).select("path", node).repartition(tasks, "path", "node")
    hashed = parts.mapInArrow(_range_hashes(size), "path string, node bigint, hash string")
    others = [r.path for r in files.where(~by_range).select("path").collect()]
    if others:  # stores that only Spark reads: whole values, cut into the same ranges
        start = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.length("content") / size) - 1, F.lit(0)).cast("bigint"))
        cut = F.transform(start, lambda n: F.struct(n.alias("node"), F.sha2(F.substring("content", (n * size + 1).cast("int"), F.lit(size)), 256).alias("hash")))
        whole = spark.read.format("binaryFile").load(others).select("path", F.inline(cut))
        hashed = hashed.unionByName(whole)
    while True:
        if found.most <= size:
            return files.join(hashed.select("path", F.col("hash").alias("checksum")), "path", "left")
        pair = F.struct("node", "hash")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["hash"]), "")
        several = F.count("*") > 1
        up = hashed.groupBy("path", F.floor(F.col("node") / fanout).alias("node")).agg(F.when(several, F.sha2(text, 256)).otherwise(F.first("hash")).alias("hash"))
        hashed, size = up, size * fanout


def _opened(scheme: str):
    """A file system that reads by offset, or None if there is none for the scheme."""
    name = scheme.partition(":")[0].lower()
    if name in ("", "file"):
        return fs.LocalFileSystem()
    try:
        return fs.FileSystem.from_uri(scheme.rstrip("/") + "/")[0]
    except (pa.ArrowException, OSError, ValueError):
        return None


def _range_hashes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, fs.FileSystem] = {}
        for batch in batches:
            hashes = []
            for path, node in zip(batch.column("path").to_pylist(), batch.column("node").to_pylist()):
                scheme = re.match(SCHEME, path).group(1) or ""
                if scheme not in systems:
                    systems[scheme] = _opened(scheme)
                with systems[scheme].open_input_file(path[len(scheme) :]) as file:
                    hashes.append(hashlib.sha256(file.read_at(min(size, max(0, file.size() - node * size)), node * size)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("node"), pa.array(hashes, pa.string())], names=["path", "node", "hash"])

    return run


def combined_checksum(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number of files below ``path`` and one checksum of them all.

    A single file has its own. Several are summed up in four words, over hashes
    of relative path and checksum, so that order does not matter, any number fits
    and equal files do not cancel out.
    """
    root = resolved(F.lit(path))
    plain = F.regexp_replace(resolved(F.col("path")), r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    inner = F.expr("substr(_plain, length(_root) + 1)")
    sums = checksums(spark, path).withColumns({"_plain": plain, "_root": F.regexp_replace(root, r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")})
    each = sums.select("checksum", F.sha2(F.concat_ws("\n", inner, "checksum"), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 1 + 16 * n, 16), 16, 10).cast("decimal(20,0)")).alias(f"w{n}") for n in range(4)]
    found = each.agg(F.count("*").alias("n"), F.min("checksum").alias("one"), *words).first()
    if found.n <= 1:
        return found.n, found.one
    total = f"{found.n}\n" + "\n".join(str(found[f"w{n}"]) for n in range(4))
    return found.n, hashlib.sha256(total.encode()).hexdigest()


def change_status(incoming: DataFrame, cataloged: DataFrame) -> DataFrame:
    """Incoming against cataloged sources: new, changed, unchanged or absent."""
    both = incoming.select("source_id", F.col("checksum").alias("_new")).join(
        cataloged.select("source_id", F.col("content_checksum").alias("_old")), "source_id", "full"
    )
    status = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "absent")
        .when(F.col("_new") == F.col("_old"), "unchanged")
        .otherwise("changed")
    )
    return both.select("source_id", status.alias("status"))
