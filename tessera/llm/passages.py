"""Byte passages that repeat across documents, by threshold-bounded interval expansion.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier
(smaller doc_id, or earlier in the same document).

1. Every window of ``LENGTH`` bytes has an anchor, the ``GRAM`` bytes in it with
   the least hash (the first of equals). Equal windows have equal anchors at the
   same place, so windows need to be compared under one anchor only. Neighbouring
   windows with the same anchor are a segment: about one in 35 bytes starts one.
2. Anchors that occur once are dropped after counting them; the segments of the
   others are cut from the texts, and equal ones become one with the first place.
3. Segments go to tasks by anchor. A task joins them to one string, sorts its
   rotations as far as ``LENGTH`` bytes need, takes the Burrows-Wheeler transform
   and extends intervals backwards, breadth first: level l finds the rows whose
   common prefix with the row before is l bytes long. It stops at ``LENGTH``; rows
   without a value by then begin alike for ``LENGTH`` bytes, and all windows of
   such a run but the earliest are repeats.
4. What was found for a segment holds for the first of its places; at its other
   places all windows are repeats. Documents get their spans back and lose them.

An anchor with one segment needs no transform: two windows of a segment hold the
anchor at different places, so they differ. An anchor with more than ``HOT`` bytes
of different segments goes to no task as a whole; its windows are dealt out one by
one under their own digests.

Defined results: null and empty texts have 0 bytes; matches never cross
documents; rows that are equal in id and text are one document and lose the
same; texts under one id are told apart by 64-bit hashes and come in their order;
null ids come first; ids are whole numbers (others fail); a text may lose
characters' halves, since bytes count; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.texts import batch_of, dropped, portions, raw, written
from tessera.session import checkpointed, small

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes of text hashed at once, and of segments sorted at once (arrays that fit into a core's cache).
PIECE, TOGETHER = 1 << 20, 1 << 19
#: Bytes of different segments above which an anchor is hot.
HOT = 1 << 21
#: Ends a segment: no byte of UTF-8.
END = 0xFF


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position, by doubling."""
    out, factor, size = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            out = out[:-size] * factor + out[size:]
            factor, size = factor * factor, 2 * size
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def segments(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Piece, first window, number of windows and anchor hash of each segment of pieces of ``data``."""
    none = np.zeros(0, np.int64)
    counts = np.maximum(lengths - LENGTH + 1, 0)
    if not counts.sum():
        return none, none, none, none
    hashes = gram_hashes(data)
    # The high half of the hash, then the place: the least is the first of equals.
    least = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < SPAN:
        least = np.minimum(least[: size - SPAN], least[SPAN - size :])
    owner = np.repeat(np.arange(len(starts)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    anchor = (least[starts[owner] + window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[new], window[new], np.diff(np.append(new, len(anchor))), hashes[anchor[new]].view(np.int64)


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in parts of at most about ``PIECE`` bytes that hold each window once.

    Yields the bytes, and of each part in them text, offset, start and length.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        for offset in range(0, len(text) - LENGTH + 1, PIECE):
            part = text[offset : offset + PIECE + LENGTH - 1]
            held.append((i, offset, part))
            size += len(part)
            if size >= PIECE:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(held):
    lengths = np.array([len(part) for _, _, part in held])
    data = np.frombuffer(b"".join(part for _, _, part in held), np.uint8)
    return data, np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held]), np.cumsum(lengths) - lengths, lengths


#: A place in one number: first window and number of windows (7 bits).
def packed(window, count):
    return (window << 7) | count


#: What names a text, and what sorts it among the others.
TEXT = "id", "hash"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("hash"), "text")


def on_text(left: DataFrame, right: DataFrame):
    return left["id"].eqNullSafe(right["id"]) & (left["hash"] == right["hash"])


def anchors(docs: DataFrame, counted: bool) -> DataFrame:
    """``anchor, n`` of the texts of a task at a time, or ``anchor, id, hash, place`` of every segment."""

    def run(batches):
        for batch in portions(batches, "text"):
            for data, owner, offset, starts, lengths in pieces(raw(batch, "text")):
                part, window, count, anchor = segments(data, starts, lengths)
                if counted:
                    anchor, n = np.unique(anchor, return_counts=True)
                    yield batch_of(anchor=anchor, n=np.minimum(n, 2))
                    continue
                own = pa.array(owner[part])
                yield batch_of(anchor=anchor, id=batch.column("id").take(own), hash=batch.column("hash").take(own), place=packed(window + offset[part], count))

    # Equal rows are one document; dealing them out by id would cost a shuffle of all texts,
    # so their anchors count twice, which only means that they are looked at.
    return keyed(docs).mapInArrow(run, "anchor bigint, n bigint" if counted else "anchor bigint, id bigint, hash bigint, place bigint")


def cut(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``name, anchor, segment, id, hash, place`` of the listed segments; ``name`` is a 128-bit digest of the bytes."""
    lists = repeated.groupBy(*TEXT).agg(F.collect_set(F.struct("anchor", "place")).alias("places"))
    rows = keyed(docs)
    rows = rows.join(lists, on_text(rows, lists)).select(rows["id"], rows["hash"], "text", "places")

    def run(batches):
        for batch in portions(batches, "text"):
            listed = batch.column("places")
            counts = np.asarray(pa.compute.list_value_length(listed))
            anchor, place = (np.asarray(x) for x in listed.flatten().flatten())
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((place, owner))  # neighbours overlap, which the table's compression sees
            anchor, place = anchor[order], place[order]
            first = place >> 7
            end = first + (place & 0x7F) + LENGTH - 1
            texts = raw(batch, "text")
            segment = [texts[i][a:b] for i, a, b in zip(owner.tolist(), first.tolist(), end.tolist())]
            yield batch_of(
                name=pa.array(map(xxhash.xxh3_128_digest, segment), pa.binary()),
                anchor=anchor,
                segment=pa.array(segment, pa.binary()),
                id=batch.column("id").take(pa.array(owner)),
                hash=batch.column("hash").take(pa.array(owner)),
                place=place,
            )

    return rows.mapInArrow(run, "name binary, anchor bigint, segment binary, id bigint, hash bigint, place bigint")


def rotations(data: np.ndarray, depth: int) -> np.ndarray:
    """The rotations of ``data`` sorted by their first ``depth`` bytes or more.

    Sorted by eight bytes, then twice as many in each round; only rotations that
    are still equal are sorted again, by what follows.
    """
    n = len(data)
    key = data.astype(np.uint64)
    for shift in (1, 2, 4):  # eight bytes at once
        key = (key << np.uint64(8 * shift)) | np.roll(key, -shift)
    order = np.argsort(key)
    ranked, places = key[order], np.arange(n)
    rank = np.empty(n, np.int64)  # where the equals of a rotation begin
    size, sub = 8, order
    while True:
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        rank[sub] = np.maximum.accumulate(np.where(new, places, 0))
        tied = ~(new & np.append(new[1:], True))
        if size >= depth or not tied.any():
            return order
        places, sub = places[tied], sub[tied]
        key = rank[sub] * n + rank[(sub + size) % n]
        by_key = np.argsort(key)
        ranked, sub = key[by_key], sub[by_key]
        order[places] = sub
        size *= 2


def common_prefixes(bwt: np.ndarray, least: int) -> np.ndarray:
    """For each row of the transform the length of its common prefix with the row before, -1 for ``least`` or more.

    ``step`` leads from a row to the row of the rotation that begins one byte
    earlier. An interval of rows that share a prefix, extended by a byte to the
    left, lies between the steps of the first and the last row that hold it.
    """
    n = len(bwt)
    by_byte = np.argsort(bwt, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)
    step[by_byte] = np.arange(n, dtype=np.int32)
    equal = bwt[by_byte[1:]] == bwt[by_byte[:-1]]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by_byte[1:][equal]] = by_byte[:-1][equal]
    after[by_byte[:-1][equal]] = by_byte[1:][equal]
    found = np.full(n + 1, -1, np.int16)
    found[0] = found[n] = 0
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    for length in range(least):
        sizes = high - low
        alone = sizes == 1  # one row, one byte: nothing to look for
        single = step[low[alone]]
        low, high, sizes = low[~alone], high[~alone], sizes[~alone]
        interval = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
        rows = np.arange(len(interval), dtype=np.int32) + (low - (np.cumsum(sizes) - sizes).astype(np.int32))[interval]
        first, last = before[rows] < low[interval], after[rows] >= high[interval]
        # Both list each byte of each interval once, and are paired by interval and byte.
        one, two = (np.argsort(interval[x].astype(np.int64) * 256 + bwt[rows[x]]) for x in (first, last))
        low = np.concatenate([single, step[rows[first][one]]])
        high = np.concatenate([single, step[rows[last][two]]]) + 1
        fresh = found[high] < 0
        if length == 0:  # the blocks of single bytes; the last one ends with all
            fresh |= high == n
        low, high = low[fresh], high[fresh]
        found[high] = length
        if not len(low):
            break
    return found[:n]


def repeats(segment: pa.BinaryArray, id_: np.ndarray, hash_: np.ndarray, place: np.ndarray) -> pa.ListArray:
    """For each segment the windows that start earlier somewhere else among the segments."""
    lengths = np.asarray(pa.compute.binary_length(segment)).astype(np.int64)
    sizes = lengths + 1
    starts = np.cumsum(sizes) - sizes
    data = np.full(sizes.sum(), END, np.uint8)
    first = segment.offset
    edges = np.frombuffer(segment.buffers()[1], np.int32)[first : first + len(segment) + 1]
    bytes_ = np.frombuffer(segment.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    data[np.arange(len(bytes_)) + np.repeat(np.arange(len(sizes)), lengths)] = bytes_
    order = rotations(data, LENGTH)
    prefix = common_prefixes(data[order - 1], LENGTH)
    group = np.cumsum(prefix >= 0)
    counts = sizes - LENGTH
    owner = np.repeat(np.arange(len(sizes)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    groups = np.empty(len(data), np.int64)
    groups[order] = group
    mine = groups[starts[owner] + inside]
    rank = np.lexsort(((place[owner] >> 7) + inside, hash_[owner], id_[owner], mine))
    later = np.zeros(len(mine), bool)
    later[rank[1:]] = mine[rank[1:]] == mine[rank[:-1]]
    offsets = np.append(0, np.cumsum(np.bincount(owner[later], minlength=len(sizes))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(inside[later], pa.int32()))


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``name, id, hash, place, late``: which windows of the first place of each segment are repeats.

    Rows come sorted by anchor. Anchors with one segment have no repeats; the
    segments of the others are settled some ``TOGETHER`` bytes at a time.
    """

    def rows(part: pa.RecordBatch, late: pa.ListArray) -> pa.RecordBatch:
        return batch_of(**{name: part.column(name) for name in ("name", *TEXT, "place")}, late=late)

    def judged(part: pa.RecordBatch) -> pa.RecordBatch:
        lowest = np.iinfo(np.int64).min  # null ids come first
        ids = np.asarray(pa.compute.fill_null(part.column("id"), lowest))
        return rows(part, repeats(part.column("segment"), ids, np.asarray(part.column("hash")), np.asarray(part.column("place"))))

    def whole(*parts: pa.RecordBatch) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    waiting, open_ = None, None  # rows of closed anchors with several segments, and of the last anchor
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if open_ is None else whole(open_, batch)
        anchor = np.asarray(batch.column("anchor"))
        begins = np.append(0, np.flatnonzero(np.diff(anchor)) + 1)
        batch, open_ = batch.slice(0, begins[-1]), batch.slice(begins[-1])
        if not batch.num_rows:
            continue
        alone = np.repeat(np.diff(begins) == 1, np.diff(begins))
        one = batch.filter(pa.array(alone))
        if one.num_rows:
            yield rows(one, pa.array([[]] * one.num_rows, pa.list_(pa.int32())))
        several = batch.filter(pa.array(~alone))
        if not several.num_rows:
            continue
        waiting = several if waiting is None else whole(waiting, several)
        ends = np.cumsum(np.asarray(pa.compute.binary_length(waiting.column("segment"))).astype(np.int64))
        closes = np.append(np.flatnonzero(np.diff(np.asarray(waiting.column("anchor")))), waiting.num_rows - 1)
        start, done = 0, 0
        while ends[-1] - done >= TOGETHER:
            stop = int(closes[np.searchsorted(ends[closes], done + TOGETHER)]) + 1
            yield judged(waiting.slice(start, stop - start))
            start, done = stop, int(ends[stop - 1])
            if stop == waiting.num_rows:
                break
        waiting = waiting.slice(start) if start < waiting.num_rows else None
    left = [x for x in (waiting, open_) if x is not None]
    if left:
        yield judged(whole(*left))


def hot_windows(parts: DataFrame) -> DataFrame:
    """What ``settle`` returns, for segments of hot anchors: each window by itself."""
    first, count = F.shiftright("place", 7), F.col("place").bitwiseAND(0x7F).cast("int")
    spread = parts.select("name", *TEXT, "place", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"), "segment")
    # 128 bits of a digest stand for the bytes, as they do for whole segments.
    spread = spread.withColumn("window", F.expr(f"substring(unhex(sha2(substring(segment, i + 1, {LENGTH}), 256)), 1, 16)")).drop("segment")
    here = F.struct(*TEXT, (first + F.col("i")).alias("at"))
    earliest = spread.groupBy("window").agg(F.min(here).alias("earliest"))
    late = F.when(~here.eqNullSafe(F.col("earliest")), F.col("i"))
    return spread.join(earliest, "window").groupBy("name", *TEXT, "place").agg(F.collect_list(late).alias("late"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``id, hash, spots``: the segments of each document that hold repeats, with those windows (null: all)."""
    # Each step is written before the next: shuffle files of several would not fit beside each other,
    # and a join of two tables can be split where an anchor is frequent.
    often = anchors(docs, True).groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("anchor")
    often = written(often, "often")
    found = written(anchors(docs, False).join(often, "anchor"), "anchors")
    parts = written(cut(docs, found), "segments")
    dropped(often, found)
    start = F.shiftright("place", 7).alias("start")
    one = parts.groupBy("anchor", "segment").agg(F.min(F.struct(*TEXT, start, "name", "place")).alias("first"))
    dealt = written(one.select("anchor", "first.name", "segment", "first.id", "first.hash", "first.place"), "distinct")
    size = F.sum(F.col("place").bitwiseAND(0x7F) + LENGTH - 1)
    hot = small(checkpointed(docs.sparkSession, dealt.groupBy("anchor").agg(size.alias("size")).where(F.col("size") > HOT).select("anchor")))
    some = not hot.isEmpty()
    whole = dealt.join(hot, "anchor", "left_anti") if some else dealt
    whole = whole.repartition("anchor").sortWithinPartitions("anchor")
    verdicts = [written(whole.mapInArrow(settle, "name binary, id bigint, hash bigint, place bigint, late array<int>"), "repeats")]
    if some:
        verdicts.append(written(hot_windows(dealt.join(hot, "anchor", "left_semi")), "repeats"))
    dropped(dealt)
    known = reduce(DataFrame.unionByName, verdicts).select("name", *(F.col(c).alias(f"first_{c}") for c in (*TEXT, "place")), "late")
    first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash")) & (F.col("place") == F.col("first_place"))
    spots = parts.select("name", *TEXT, "place").join(known, "name").withColumn("late", F.when(first, F.col("late")))
    spots = spots.where(F.col("late").isNull() | (F.size("late") > 0))
    spots = written(spots.groupBy(*TEXT).agg(F.collect_set(F.struct("place", "late")).alias("spots")), "spots")
    dropped(parts, *verdicts)
    return spots


def spans(spots: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (by position), begin and end of the maximal runs of repeated bytes, in order."""
    document = np.repeat(np.arange(len(spots)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(spots), 0)))
    place, late = spots.flatten().flatten()
    place = np.asarray(place)
    some = np.asarray(late.is_valid())  # else all windows of the segment
    counts = np.where(some, np.asarray(pa.compute.fill_null(pa.compute.list_value_length(late), 0)), place & 0x7F)
    spot = np.repeat(np.arange(len(place)), counts)
    inside = np.arange(len(spot)) - np.repeat(np.cumsum(counts) - counts, counts)
    inside[some[spot]] = np.asarray(late.flatten())
    document, start = document[spot], (place >> 7)[spot] + inside
    order = np.lexsort((start, document))
    document, start = document[order], start[order]
    new = np.ones(len(start), bool)
    new[1:] = (document[1:] != document[:-1]) | (start[1:] > start[:-1] + LENGTH)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1) if len(start) else np.zeros(0, np.int64)
    return document[new], start[new], start[last] + LENGTH


def removed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the runs (start, end) to remove from each row and the bytes that stay."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, gone = keyed(docs).withColumn("doc_id", F.col("id").cast(kind)), repeated_windows(docs)
    rows = rows.join(gone, on_text(rows, gone), "left").select("doc_id", "text", "spots")

    def run(batches):
        for batch in portions(batches, "text"):
            texts = raw(batch, "text")
            document, start, end = spans(batch.column("spots"))
            ends = np.searchsorted(document, np.arange(len(texts) + 1))
            kept = []
            for i, text in enumerate(texts):
                own = slice(ends[i], ends[i + 1])
                edges = zip([0, *end[own].tolist()], [*start[own].tolist(), len(text)])
                kept.append(b"".join(text[a:b] for a, b in edges) if ends[i] < ends[i + 1] else text)
            run_of = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])
            yield batch_of(
                doc_id=batch.column("doc_id"),
                n_bytes=np.array(list(map(len, texts)), np.int64),
                spans=pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), run_of),
                kept=pa.array(kept, pa.binary()),
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def summary(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``."""
    return removed(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
