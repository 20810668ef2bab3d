"""Hard negatives by threshold joins over an inverted index with norm bounds.

Vectors are of integers, scores are exact inner products. What is wanted of an
anchor is told by windows: the ``most`` best rows of the same (or of another)
label whose scores lie between two bounds. Positives are one window without
bounds; each positive opens a window for its negatives.

Windows are filled by threshold joins of anchors with all rows, in blocks: every
block of anchors meets every slice of rows in a task that streams through the
rows and keeps the best of each window.

1. Dimensions are ordered by how much the anchors weigh in them. For each row the
   norm of what lies behind a dimension, times the largest norm of an anchor, is
   a bound for what that rest can add. The inverted index lists a row under its
   first dimensions only, up to where this bound falls below all thresholds: a
   pair that shares no listed dimension cannot reach any. Rows are sorted by how
   many dimensions list them, so the list of a dimension is a prefix.
2. Partial scores are accumulated over lists, a few dimensions at a time. A pair
   goes on only while its partial score plus the product of the norms of both
   rests reaches the threshold of its anchor; rows and anchors without such a
   pair drop out of the lists, and few remaining pairs are followed one by one.
3. A threshold starts high in its window, and lower ones follow in further joins
   for the windows that did not fill; the last one is the lower bound itself. In
   a task a threshold rises with the worst score of a full window.

Everything a threshold leaves out is below it, so results are exact.

Defined results: rows with a null id, label or vector, or a null component, and
rows whose squared norm does not fit into 62 bits take no part; missing
components of shorter vectors are zero; rows that are equal in id, label and
vector are one, and different rows under one id are rows of their own (an anchor
is no candidate of itself, but another row under its id is); equal scores are in
the order of ids, then of hashes of their vectors; a positive whose window is
empty has no negatives; an empty table has none; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.texts import batch_of
from tessera.session import checkpointed

#: Expected anchors in a block, and rows in a slice.
ANCHORS, SLICE = 1 << 14, 1 << 12
#: Anchors and rows whose scores are accumulated at once, and dimensions in a step.
SIDE, ROWS, STEP = 512, 4096, 8
#: Where the thresholds of the joins lie between the upper (0) and the lower bound (1) of a window.
LEVELS = (0.375, 0.5, 1.0)
#: Norms whose products float64 adds exactly, and those that fit into a long.
EXACT, LARGEST = 2.0**52, 2.0**62

BEST = "anchor bigint, anchor_mark bigint, number int, score bigint, id bigint, mark bigint"


def vectors(rows: DataFrame) -> DataFrame:
    """``id, label, v, mark`` of the rows that take part, each once; ``mark`` tells rows under one id apart."""
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    found = rows.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("string").alias("label"), F.col("v").cast("array<bigint>").alias("v"))
    found = found.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    found = found.where(F.forall("v", lambda x: x.isNotNull()) & (norm < LARGEST))
    return found.withColumn("mark", F.xxhash64("label", "v")).dropDuplicates(["id", "mark"])


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as rows of ``width`` numbers."""
    sizes = np.asarray(pa.compute.list_value_length(column))
    flat = np.asarray(column.flatten())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rest_norms(x: np.ndarray) -> np.ndarray:
    """For each row and step the norm of its dimensions from there on, rounded up."""
    squares = x.astype(float) ** 2
    behind = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.column_stack([behind[:, ::STEP], np.zeros(len(x))])) * (1 + 1e-9)


class NormIndex:
    """An inverted index over ``rows`` for anchors of norms up to ``norm`` and scores from ``threshold`` on."""

    def __init__(self, rows: np.ndarray, norm: float, threshold: float):
        rest = rest_norms(rows)
        self.slack = 1e-12 * norm * float(rest[:, 0].max(initial=0))
        listed = (rest[:, :-1] * norm >= threshold - self.slack).sum(axis=1)  # steps; rests only get smaller
        self.order = np.argsort(-listed, kind="stable")
        self.listed, self.rest = listed[self.order], rest[self.order]
        self.lists = np.ascontiguousarray(rows[self.order].T)
        self.steps = rest.shape[1] - 1

    def reach(self, anchors: np.ndarray, thresholds: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of all ``wanted`` pairs whose scores reach the anchor's threshold."""
        rest = rest_norms(anchors)
        left, right = np.arange(len(anchors)), np.arange(int((self.listed > 0).sum()))
        score = np.zeros((len(left), len(right)), anchors.dtype)
        going = wanted[:, self.order[right]]
        for step in range(self.steps):
            part = slice(step * STEP, (step + 1) * STEP)
            n = int(np.searchsorted(-self.listed[right], -step, side="left"))  # those still listed come first
            score[:, :n] += anchors[left, part] @ self.lists[part, right[:n]]
            behind = np.minimum(step + 1, self.listed[right])
            going &= score + rest[left][:, behind] * self.rest[right, behind] * (1 + 1e-9) >= self.loose(thresholds[left])[:, None]
            if 16 * np.count_nonzero(going) <= going.size:
                break
            rows, columns = going.any(axis=1), going.any(axis=0)
            if rows.sum() < 0.75 * len(rows) or columns.sum() < 0.75 * len(columns):
                left, right = left[rows], right[columns]
                score, going = score[np.ix_(rows, columns)], going[np.ix_(rows, columns)]
        i, j = np.nonzero(going)
        return self.follow(anchors, rest, thresholds, left[i], right[j], score[i, j], step + 1)

    def loose(self, thresholds: np.ndarray) -> np.ndarray:
        """Thresholds as floats, low enough for any rounding."""
        return thresholds - self.slack

    def follow(self, anchors, rest, thresholds, i, j, score, step) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for single pairs whose first steps, as far as they are listed, are in ``score``."""
        done = np.minimum(step, self.listed[j])
        for step in range(int(done.min(initial=self.steps)), self.steps):
            part = slice(step * STEP, (step + 1) * STEP)
            now = done == step
            score[now] += (anchors[i[now], part] * self.lists[part, j[now]].T).sum(axis=1)
            done[now] += 1
            keep = score + rest[i, done] * self.rest[j, done] * (1 + 1e-9) >= self.loose(thresholds[i])
            i, j, score, done = i[keep], j[keep], score[keep], done[keep]
        keep = score >= thresholds[i]
        return i[keep], self.order[j[keep]], score[keep]


class Windows:
    """The anchors of a block with their windows, and the best rows found for these."""

    def __init__(self, batch: pa.RecordBatch, same: bool, most: int):
        self.same, self.most = same, most
        self.width = int(max(np.asarray(pa.compute.list_value_length(batch.column("v"))).max(initial=0), 1))
        self.vectors = matrix(batch.column("v"), self.width)
        self.id, self.mark = (np.asarray(batch.column(c)) for c in ("id", "mark"))
        self.codes: dict[str, int] = {}
        self.label = np.array([self.codes.setdefault(x, len(self.codes)) for x in batch.column("label").to_pylist()], np.int64)
        held = batch.column("windows")
        self.owner = np.repeat(np.arange(len(self.id)), np.asarray(pa.compute.list_value_length(held)))
        number, high, start = held.flatten().flatten()
        self.number, self.high, self.threshold = (np.array(x) for x in (number, high, start))
        self.found = [np.zeros((0, 4), np.int64)]  # window, score, id, mark
        self.waiting = 0

    def batch(self, batch: pa.RecordBatch) -> None:
        widest = int(max(np.asarray(pa.compute.list_value_length(batch.column("v"))).max(initial=0), self.width))
        rows = matrix(batch.column("v"), widest)[:, : self.width]  # what no anchor of the block has adds nothing
        ids, marks = (np.asarray(batch.column(c)) for c in ("id", "mark"))
        labels = np.array([self.codes.get(x, -1) for x in batch.column("label").to_pylist()], np.int64)
        weight = np.argsort(-(self.vectors.astype(float) ** 2).sum(axis=0), kind="stable")
        for start in range(0, len(rows), ROWS):
            part = slice(start, start + ROWS)
            self.block(rows[part][:, weight], ids[part], marks[part], labels[part], weight)

    def block(self, rows, ids, marks, labels, weight) -> None:
        for start in range(0, len(self.id), SIDE):
            side = slice(start, start + SIDE)
            anchors = self.vectors[side][:, weight]
            norms = [np.sqrt((x.astype(float) ** 2).sum(axis=1).max(initial=0)) for x in (anchors, rows)]
            kind = np.float64 if norms[0] * norms[1] < EXACT else np.int64
            own = (self.owner >= start) & (self.owner < start + len(anchors))
            thresholds = np.full(len(anchors), np.iinfo(np.int64).max)
            np.minimum.at(thresholds, self.owner[own] - start, self.threshold[own])
            equal = self.label[side][:, None] == labels[None]
            itself = (self.id[side][:, None] == ids[None]) & (self.mark[side][:, None] == marks[None])
            index = NormIndex(rows.astype(kind), norms[0] * (1 + 1e-9), float(thresholds.min()))
            i, j, score = index.reach(anchors.astype(kind), thresholds, (equal == self.same) & ~itself)
            self.offer(i + start, j, score.astype(np.int64), ids, marks)

    def offer(self, i, j, score, ids, marks) -> None:
        """Give each pair to the windows of its anchor that its score lies in."""
        begin = np.searchsorted(self.owner, i, side="left")
        count = np.searchsorted(self.owner, i, side="right") - begin
        pair = np.repeat(np.arange(len(i)), count)
        window = begin[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        fits = (score[pair] >= self.threshold[window]) & (score[pair] <= self.high[window])
        pair, window = pair[fits], window[fits]
        self.found.append(np.stack([window, score[pair], ids[j[pair]], marks[j[pair]]], axis=1))
        self.waiting += len(pair)
        if self.waiting > 4 * self.most * len(self.owner) + 10_000:
            self.best()

    def best(self) -> np.ndarray:
        """Only the ``most`` best rows of each window; a full window raises its threshold to the worst of them."""
        all_ = np.concatenate(self.found)
        order = np.lexsort((all_[:, 3], all_[:, 2], -all_[:, 1], all_[:, 0]))
        all_ = all_[order]
        new = np.flatnonzero(np.diff(all_[:, 0], prepend=-1))
        rank = np.arange(len(all_)) - np.repeat(new, np.diff(np.append(new, len(all_))))
        full = all_[rank == self.most - 1]
        self.threshold[full[:, 0]] = np.maximum(self.threshold[full[:, 0]], full[:, 1])
        self.found, self.waiting = [all_[rank < self.most]], 0
        return self.found[0]

    def result(self) -> pa.RecordBatch:
        window, score, id_, mark = self.best().T
        owner = self.owner[window]
        return batch_of(anchor=self.id[owner], anchor_mark=self.mark[owner], number=self.number[window].astype(np.int32), score=score, id=id_, mark=mark)


def streamed(same: bool, most: int):
    """A task's work: blocks of anchors, each before the rows of its slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held, key = None, [], None
        for batch in batches:
            block, slice_, kind = (np.asarray(batch.column(c)) for c in ("block", "slice", "kind"))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(slice_) != 0) | (np.diff(kind) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(start, stop - start)
                if key != (block[start], slice_[start]):
                    if windows is not None:
                        yield windows.result()
                    windows, held, key = None, [], (block[start], slice_[start])
                if kind[start] == 0:
                    held.append(part)
                elif held or windows is not None:
                    if held:
                        windows, held = Windows(pa.Table.from_batches(held).combine_chunks().to_batches()[0], same, most), []
                    windows.batch(part)
        if windows is not None:
            yield windows.result()

    return run


def joined(rows: DataFrame, wanted: DataFrame, n_rows: int, n_anchors: int, same: bool, most: int) -> DataFrame:
    """``BEST``: the ``most`` best rows of each window in ``wanted`` (id, mark, label, v, windows) at its threshold."""
    spark = rows.sparkSession
    blocks = -(-n_anchors // ANCHORS)
    # As many slices as keep all cores busy, and no more than there are rows for: each returns its own best.
    slices = max(1, min(-(-n_rows // SLICE), 2 * -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)))
    number = lambda n, *salt: F.pmod(F.xxhash64("id", "mark", *salt), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = "block", "slice", "kind", "id", "mark", "label", "v", "windows"
    asking = wanted.withColumn("block", number(blocks)).withColumn("slice", every(slices)).withColumn("kind", F.lit(0))
    asked = rows.withColumn("block", every(blocks)).withColumn("slice", number(slices, F.lit(1))).withColumn("kind", F.lit(1))
    asked = asked.withColumn("windows", F.lit(None).cast(wanted.schema["windows"].dataType))
    dealt = asking.select(*columns).unionByName(asked.select(*columns))
    # By a number, so that a join of few bytes but many scores is not put into one task.
    dealt = dealt.repartition(blocks * slices, "block", "slice").sortWithinPartitions("block", "slice", "kind")
    found = dealt.mapInArrow(streamed(same, most), BEST)
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("back"), "id", "mark")))
    # A slice returns at most ``most`` rows of a window, so a group holds at most slices times as many.
    ranked = found.groupBy("anchor", "anchor_mark", "number").agg(F.slice(best, 1, most).alias("best"))
    ranked = ranked.select("anchor", "anchor_mark", "number", F.posexplode("best").alias("rank", "b"))
    return ranked.select("anchor", "anchor_mark", "number", (F.col("rank") + 1).alias("rank"), (-F.col("b.back")).alias("score"), "b.id", "b.mark")


def filled(rows: DataFrame, windows: DataFrame, same: bool, most: int) -> DataFrame:
    """The best rows of every window of ``windows`` (anchor, anchor_mark, number, low, high), as ``joined`` returns them.

    Thresholds are lowered, join by join, for the windows that are not full.
    """
    spark = rows.sparkSession
    n_rows, done = rows.count(), None
    open_ = checkpointed(spark, windows)
    for level in LEVELS:
        n_anchors = open_.select("anchor", "anchor_mark").distinct().count()
        if not n_anchors:
            break
        span = F.col("high").cast("double") - F.col("low")
        start = F.greatest("low", F.floor(F.col("high") - span * level).cast("bigint")) if level < 1 else F.col("low")
        own = open_.groupBy("anchor", "anchor_mark").agg(F.collect_list(F.struct("number", "high", start.alias("start"))).alias("windows"))
        named = own.select(F.col("anchor").alias("id"), F.col("anchor_mark").alias("mark"), "windows")
        found = checkpointed(spark, joined(rows, rows.join(named, ["id", "mark"]), n_rows, n_anchors, same, most))
        key = ["anchor", "anchor_mark", "number"]
        if level < 1:
            full = found.where(F.col("rank") == most).select(key)
            found = found.join(full, key, "left_semi")
            open_ = checkpointed(spark, open_.join(full, key, "left_anti"))
        done = found if done is None else done.unionByName(found)
    return spark.createDataFrame([], f"{BEST}, rank int") if done is None else done


def hard_negatives(rows: DataFrame, asks: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among ``rows`` (id, label, v).

    Anchors are the rows for whose ``id`` the condition ``asks`` holds. Their
    positives are the ``positives`` best other rows of their label; for each, the
    ``negatives`` best rows of other labels are returned that score between
    ``least`` and ``most`` percent of the positive.
    """
    spark = rows.sparkSession
    rows = checkpointed(spark, vectors(rows))
    # No product of two norms is larger.
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    largest = rows.agg(F.max(norm)).first()[0] or 0.0
    limit = F.ceil(F.least(norm * largest * (1 + 1e-9), F.lit(LARGEST * 0.999)))
    anchors = rows.where(asks).select(F.col("id").alias("anchor"), F.col("mark").alias("anchor_mark"), limit.cast("bigint").alias("high"))
    whole = anchors.select("anchor", "anchor_mark", F.lit(0).alias("number"), (-F.col("high")).alias("low"), "high")
    known = checkpointed(spark, filled(rows, whole, True, positives).select("anchor", "anchor_mark", F.col("rank").alias("number"), F.col("id").alias("positive"), "score"))
    # From percents of long scores to bounds, without leaving whole numbers.
    score, hundred = F.col("score").cast("decimal(38,0)"), F.lit(100).cast("decimal(10,0)")
    low, high = F.ceil(score * least / hundred).cast("bigint"), F.floor(score * most / hundred).cast("bigint")
    opened = known.select("anchor", "anchor_mark", "number", low.alias("low"), high.alias("high")).where(F.col("low") <= F.col("high"))
    found = filled(rows, opened, False, negatives).withColumnsRenamed({"score": "negative_score", "id": "negative_id"}).drop("mark")
    out = known.withColumnRenamed("score", "positive_score").join(found, ["anchor", "anchor_mark", "number"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score")
