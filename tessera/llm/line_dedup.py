"""Repeated passages of several lines, found by content-defined chunks of lines.

Lines are hashed, and a hash rolls over each two neighbouring ones. Where it leaves
a given rest, a set of boundaries has a cut: cuts depend on the lines beside them
only, so a passage is cut alike wherever it stands. A single set misses nearly all
passages of a few lines, so the sets of all rests are used together; in one of them
any two neighbouring lines are the edge of a chunk, and these edges are the chunks
that are looked up:

1. Rolled hashes are counted, one number per edge and task; those that occur once
   are dropped.
2. The edges with the other hashes are listed with their places. Of equal ones the
   first occurrence (smallest id, then place) stays, later ones are repeats.
3. The lines of repeated edges are compared byte by byte: each different text of a
   line hash travels once per task, and where a hash has two texts, all edges with
   it stay.
4. In a document neighbouring repeats grow into passages, line by line both ways;
   passages of ``LEAST`` words or more are removed.

Defined results: lines end at ``\\n`` only; a line without a word (anything but
space and the characters 9 to 13) stands between lines but is none, and goes with
a passage that goes on after it; a line goes if it and a neighbour occur together
earlier, counted on the input, overlaps too; a single repeated line never goes; a
null text stays null and an empty one empty; rows that are equal in id and text
are one document, so both lose or keep the same; texts under one id come in the
order of their 64-bit hashes; null ids come first. All rows and columns stay; a
text that is repeated as a whole becomes empty.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.texts import batch_of, portions, raw, written

#: Words of the shortest passage that is removed.
LEAST = 6
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

ROW = "id", "hash"
EDGE = "rolled", "one", "two"


def solid_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the numbers of those that have a word."""
    lines = text.split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line.strip()]


def edges(texts: list[bytes], hashed: Callable[[bytes], int]) -> tuple[np.ndarray, ...]:
    """Text, number of the second line (among those with words), rolled hash and both line hashes of each edge."""
    hashes, counts = [], []
    for text in texts:
        lines, solid = solid_lines(text)
        hashes += [hashed(lines[i]) for i in solid]
        counts.append(len(solid))
    line, counts = np.array(hashes, np.uint64), np.array(counts, np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(line)) - np.repeat(np.cumsum(counts) - counts, counts)
    second = np.flatnonzero(number > 0)
    with np.errstate(over="ignore"):
        rolled = line[second - 1] * FACTOR + line[second]
        rolled = (rolled ^ (rolled >> np.uint64(31))) * MIX
    return owner[second], number[second], *(x.view(np.int64) for x in (rolled, line[second - 1], line[second]))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")


def listed(docs: DataFrame, hashed: Callable[[bytes], int], counted: bool) -> DataFrame:
    """``rolled, n`` of the texts of a portion at a time, or ``rolled, one, two, id, hash, number`` of every edge."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            owner, number, rolled, one, two = edges(raw(batch, "text"), hashed)
            if counted:
                rolled, n = np.unique(rolled, return_counts=True)
                yield batch_of(rolled=rolled, n=np.minimum(n, 2))
            else:
                own = pa.array(owner, pa.int64())
                yield batch_of(rolled=rolled, one=one, two=two, id=batch.column("id").take(own), hash=batch.column("hash").take(own), number=number)

    return keyed(docs).mapInArrow(run, "rolled bigint, n bigint" if counted else f"rolled bigint, one bigint, two bigint, id {kind}, hash bigint, number bigint")


def on_row(left: DataFrame, right: DataFrame):
    return left["id"].eqNullSafe(right["id"]) & (left["hash"] == right["hash"])


def texts_of(docs: DataFrame, wanted: DataFrame, hashed: Callable[[bytes], int]) -> DataFrame:
    """``line, text``: the different lines of the edges in ``wanted`` (id, hash, numbers), by their hashes."""
    rows = keyed(docs)
    rows = rows.hint("merge").join(wanted, on_row(rows, wanted)).select("text", "numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            found = set()
            for text, numbers in zip(raw(batch, "text"), batch.column("numbers").to_pylist()):
                lines, solid = solid_lines(text)
                found.update(lines[solid[k]] for number in numbers for k in (number - 1, number))
            found = list(found)
            line = np.array([hashed(x) for x in found], np.uint64).view(np.int64)
            yield batch_of(line=line, text=pa.array(found, pa.binary()))

    return rows.mapInArrow(run, "line bigint, text binary")


def repeats(docs: DataFrame, hashed: Callable[[bytes], int]) -> DataFrame:
    """``id, hash, numbers``: the edges of each document that occur earlier."""
    # Each step is written: nothing before it is needed again, and a join of two tables,
    # one with a row for each hash, can be split where an edge is frequent.
    often = listed(docs, hashed, True).groupBy("rolled").agg(F.sum("n").alias("n")).where("n > 1").select("rolled")
    found = written(listed(docs, hashed, False).join(written(often, "often"), "rolled"), "edges")
    place = F.struct(*ROW, "number")
    places = found.groupBy(*EDGE).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    places = written(places.where(~F.col("first").eqNullSafe(F.col("last"))).select(*EDGE, "first"), "places")
    several = written(found.join(places, list(EDGE)), "several")
    numbers = F.sort_array(F.collect_set("number")).alias("numbers")
    texts = texts_of(docs, several.groupBy(*ROW).agg(numbers), hashed).distinct().groupBy("line").count()
    unlike = written(texts.where("count > 1").select("line"), "unlike")
    later = several.where(~place.eqNullSafe(F.col("first")))
    if not unlike.isEmpty():
        for side in ("one", "two"):
            later = later.join(unlike, later[side] == unlike["line"], "left_anti")
    return later.groupBy(*ROW).agg(numbers)


def passages(lines: list[bytes], solid: list[int], numbers: list[int], least: int) -> list[tuple[int, int]]:
    """The lines (from, up to) that repeated edges make up, where they have ``least`` words."""
    runs: list[list[int]] = []
    for number in numbers:
        if runs and number - 1 <= runs[-1][1]:
            runs[-1][1] = number
        else:
            runs.append([number - 1, number])
    found = ((solid[a], solid[b] + 1) for a, b in runs)
    return [(a, b) for a, b in found if sum(len(line.split()) for line in lines[a:b]) >= least]


def line_dedup(docs: DataFrame, report: bool = False, least: int = LEAST, hashed: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``; all other columns stay as they are.

    With ``report`` the columns ``_n_lines``, ``_n_removed`` (lines) and
    ``_n_chunks`` (passages removed) are added.
    """
    gone = written(repeats(docs, hashed), "gone")
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    joined = rows.hint("merge").join(gone, rows["doc_id"].eqNullSafe(gone["id"]) & (rows["_hash"] == gone["hash"]), "left").select(*(rows[c] for c in docs.columns), gone["numbers"].alias("_numbers"))
    schema = T.StructType(list(docs.schema.fields))
    if report:
        for name in ("_n_lines", "_n_removed", "_n_chunks"):
            schema.add(name, T.LongType())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            texts, counts = batch.column("text").to_pylist(), []
            for i, (text, numbers) in enumerate(zip(raw(batch, "text"), batch.column("_numbers").to_pylist())):
                spans = []
                if numbers:
                    lines, solid = solid_lines(text)
                    spans = passages(lines, solid, numbers, least)
                if spans:
                    stays = [(a, b) for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(lines)])]
                    texts[i] = b"\n".join(line for a, b in stays for line in lines[a:b]).decode()
                counts.append((text.count(b"\n") + 1, sum(b - a for a, b in spans), len(spans)))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            if report:
                columns += [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)


def summary(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, n_chunks, n_bytes, kept_sha256`` of every row after removal."""
    cleaned = line_dedup(docs.select("doc_id", "text"), report=True)
    text = F.coalesce("text", F.lit(""))
    return cleaned.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_chunks").alias("n_chunks"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.sha2(text, 256).alias("kept_sha256"),
    )
