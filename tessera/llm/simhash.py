"""Near-duplicate documents by SimHash and a Gray-order hierarchical index.

Fingerprints are taken in numpy inside the tasks and made distinct. Of two
fingerprints that differ in at most three bits, one of four blocks of 16 bits is
equal, so Spark deals them out by block and value. What meets there is linked by
a hierarchical index: fingerprints in the order of their Gray rank, 8 under a
node, nodes under nodes. A node keeps the bits all its members share; only bits
that its parent did not already factor out are compared again, differences add
up on the way down, and a pair of nodes above three is dropped with all below.
Node pairs that are already in one component are dropped as well, so a group of
near copies never turns into all its pairs.

A bucket above ``HOT`` fingerprints is cut by Gray prefixes into ranges that fit
into a task; pairs of ranges whose shared bits differ too much are dropped, the
others become tasks of their own. Links leave a task as a star for each local
component; components are closed by alternating stars, checkpointed each round.

Defined results: a text without words (null too) has fingerprint zero and links
like any other; fewer words than a shingle are one shingle; repeated rows share
a component; rows without an id link like any other, but a null id never names a
component (if a component has no other, its id is null); different texts under
one id are linked each on its own; other columns are ignored.
"""
from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.texts import batch_of, per_portion, raw
from tessera.session import checkpointed

SHINGLE, RADIUS, BITS = 3, 3, 64
#: Distinct fingerprints of a bucket that one task links; more are cut into ranges.
HOT = 1 << 20
FANOUT = 8
#: Rows a task gathers before it builds an index over whole buckets, and node pairs compared at once.
GATHERED, PAIRS = 200_000, 1 << 15


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, with A-Z lower-cased."""
    words = text.lower().split()
    if len(words) > size:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
        return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(words) - size + 1)
    return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[start : start + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a bigint) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = np.array([fingerprint(shingle_hashes(x)) for x in raw(batch, "text")], np.uint64)
            return batch_of(doc_id=batch.column("doc_id"), fp=prints.view(np.int64))

        return step

    return per_portion(docs.select("doc_id", "text"), f"doc_id {kind}, fp bigint", work)


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """The position of each word in the sequence of Gray codes."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Links all fingerprints of the same group that differ in at most ``radius`` bits.

    ``group`` and ``prints`` are sorted by group and Gray rank. ``label`` ends as
    the smallest position of each one's component.
    """

    def __init__(self, group: np.ndarray, prints: np.ndarray, radius: int = RADIUS):
        self.radius, self.label = radius, np.arange(len(prints))
        everything = np.full(len(prints), ~np.uint64(0))
        #: For each level the shared bits, which bits are shared, and the first and last group.
        self.levels = [(prints, everything, group, group)]
        ones, zeros, first, last = prints, ~prints, group, group
        while len(ones) > 64:
            cut = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            first, last = first[cut], np.maximum.reduceat(last, cut)
            self.levels.append((ones, ones | zeros, first, last))

    def uniform(self) -> list[np.ndarray]:
        """For each level the component of a node, or -1 for nodes with several."""
        low = high = self.label
        out = [low]
        for level in self.levels[1:]:
            cut = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            out.append(np.where(low == high, low, -1 - np.arange(len(low))))
        return out

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == label[b]).all():
                return
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while not np.array_equal(label, up := label[label]):
                label = up
            self.label = label

    def linked(self) -> np.ndarray:
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        a, b = np.triu_indices(n)
        zero = np.zeros(len(a), np.uint64)
        # Depth first over chunks of pairs: level, pair of nodes, differences and bits compared so far.
        stack, same, fresh = [(top, a, b, zero.astype(np.int64), zero)], self.uniform(), True
        while stack:
            level, a, b, far, seen = stack.pop()
            if len(a) > PAIRS:
                for start in range(0, len(a), PAIRS):
                    span = slice(start, start + PAIRS)
                    stack.append((level, a[span], b[span], far[span], seen[span]))
                continue
            if not fresh:
                same, fresh = self.uniform(), True
            bits, shared, first, last = self.levels[level]
            keep = (last[a] >= first[b]) & ((same[level][a] != same[level][b]) | ((a == b) & (level > 0) & (same[level][a] < 0)))
            a, b, far, seen = a[keep], b[keep], far[keep], seen[keep]
            common = shared[a] & shared[b]
            far = far + np.bitwise_count((bits[a] ^ bits[b]) & common & ~seen)
            keep = far <= self.radius
            a, b, far, seen = a[keep], b[keep], far[keep], common[keep]
            if not len(a):
                continue
            if level == 0:
                self.union(a, b)
                fresh = False
                continue
            below = len(self.levels[level - 1][0])
            left = np.repeat(a * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(np.arange(FANOUT), FANOUT), len(a))
            right = np.repeat(b * FANOUT, FANOUT * FANOUT) + np.tile(np.arange(FANOUT), len(a) * FANOUT)
            keep = (left <= right) & (left < below) & (right < below)
            if level == 1:
                keep &= left < right
            far, seen = np.repeat(far, FANOUT * FANOUT)[keep], np.repeat(seen, FANOUT * FANOUT)[keep]
            stack.append((level - 1, left[keep], right[keep], far, seen))
        return self.label


def link_buckets(batches):
    """Stars of the local components of whole buckets; rows come sorted by bucket."""
    names = ("block", "value", "one", "two", "fp", "rep")
    held, size = [], 0

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        *key, prints, rep = columns
        changed = np.zeros(len(rep), np.int64)
        for part in key:
            changed[1:] |= part[1:] != part[:-1]
        group, prints = np.cumsum(changed), prints.view(np.uint64)
        order = np.lexsort((gray_rank(prints), group))
        prints, rep, group = prints[order], rep[order], group[order]
        label = GrayIndex(group, prints).linked()
        root = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(root, label, rep)
        root = root[label]
        return batch_of(a=rep[root != rep], b=root[root != rep])

    for batch in batches:
        held.append([np.asarray(batch.column(name)) for name in names])
        size += batch.num_rows
        if size < GATHERED:
            continue
        columns = [np.concatenate(x) for x in zip(*held)]
        last = np.ones(size, bool)  # the last bucket may go on in the next batch
        for part in columns[:4]:
            last &= part == part[-1]
        whole = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if whole:
            yield links([x[:whole] for x in columns])
        held, size = [[x[whole:] for x in columns]], size - whole
    if size:
        yield links([np.concatenate(x) for x in zip(*held)])


def ranges(buckets: DataFrame, hot: int) -> DataFrame:
    """Rows of buckets above ``hot``, once for each task: a pair of Gray ranges that may hold links.

    Ranges are Gray prefixes, made longer until none holds more than ``hot``
    fingerprints; distinct fingerprints always part in the end.
    """
    spark = buckets.sparkSession
    open_, done, bits = buckets.withColumn("prefix", F.lit(0).cast("bigint")), None, 0
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    open_ = open_.withColumn("rank", rank)
    while True:
        sized = open_.join(open_.groupBy("block", "value", "prefix").count().withColumnRenamed("count", "n"), ["block", "value", "prefix"])
        sized = checkpointed(spark, sized)
        fit = sized.where(F.col("n") <= hot).withColumn("level", F.lit(bits)).drop("n")
        done = fit if done is None else done.unionByName(fit)
        open_ = sized.where(F.col("n") > hot).drop("n")
        if bits >= BITS or open_.isEmpty():
            break
        bits += 4
        open_ = open_.withColumn("prefix", F.shiftrightunsigned("rank", BITS - bits))
    done = done.drop("rank").withColumn("range", F.xxhash64("level", "prefix"))
    nodes = done.groupBy("block", "value", "range").agg(F.expr("bit_and(fp)").alias("ones"), F.expr("bit_and(~fp)").alias("zeros"))
    other = nodes.select("block", "value", F.col("range").alias("two"), F.col("ones").alias("ones2"), F.col("zeros").alias("zeros2"))
    apart = F.bit_count((F.col("ones").bitwiseAND(F.col("zeros2"))).bitwiseOR(F.col("zeros").bitwiseAND(F.col("ones2"))))
    pairs = (
        nodes.join(other, ["block", "value"])
        .where((F.col("range") <= F.col("two")) & (apart <= RADIUS))
        .select("block", "value", F.col("range").alias("one"), "two")
    )
    # A range alone is linked in the task of each pair it is in; with itself only if nothing else needs it.
    sides = pairs.select("block", "value", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("range"))
    return done.join(sides, ["block", "value", "range"]).select("block", "value", "one", "two", "fp", "rep")


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable over ``links`` (a, b), for all nodes in links.

    Alternating large and small stars: each round hangs neighbours on the
    smallest one around. Neighbours are pre-aggregated to their minimum before
    the shuffle; links are made distinct, so they never exceed the input.
    """
    spark = links.sparkSession
    now = checkpointed(spark, links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = checkpointed(spark, small.select("e.a", "e.b").where("a != b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def linked(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, fp, node, component_id`` of every row; ``node`` is the smallest fingerprint of its component."""
    spark = docs.sparkSession
    prints = checkpointed(spark, fingerprints(docs))
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    blocks = F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF).alias("value")) for i in range(4)))
    zero = F.lit(0).cast("bigint")
    rows = (
        reps.select("fp", F.col("fp").alias("rep"), F.explode(blocks).alias("key"))
        .select(F.col("key.block").alias("block"), F.col("key.value").alias("value"), "fp", "rep")
    )
    sizes = rows.groupBy("block", "value").count()
    large = checkpointed(spark, sizes.where(F.col("count") > hot).select("block", "value"))
    tasks = rows.select("block", "value", zero.alias("one"), zero.alias("two"), "fp", "rep")
    if not large.isEmpty():
        tasks = tasks.join(large, ["block", "value"], "left_anti").select(tasks.columns)
        tasks = tasks.unionByName(ranges(rows.join(large, ["block", "value"]), hot))
    dealt = tasks.repartition("block", "value", "one", "two").sortWithinPartitions("block", "value", "one", "two")
    roots = components(dealt.mapInArrow(link_buckets, "a bigint, b bigint")).withColumnsRenamed({"node": "fp", "root": "node"})
    placed = checkpointed(spark, reps.join(roots, "fp", "left").select("fp", F.coalesce("node", "fp").alias("node"), "least"))
    # A join of two tables, one with a row for each component, can be split where a component is large.
    named = placed.join(placed.groupBy("node").agg(F.min("least").alias("component_id")), "node")
    return prints.join(named, "fp").select("doc_id", "fp", "node", "component_id")


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``."""
    return linked(docs, hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_print(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with their fingerprint as ``_fp``."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_fp", T.LongType())])

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = np.array([fingerprint(shingle_hashes(x)) for x in raw(batch, "text")], np.uint64)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=schema.names)

        return step

    return per_portion(docs, schema, work)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all columns.

    Of rows of a component that share its id one stays; texts under one id that
    are in different components all stay if the id names these. Rows without an
    id stay if no row of their component has one.
    """
    spark = docs.sparkSession
    found = checkpointed(spark, linked(docs))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_print"), F.col("node").alias("_node")).distinct()
    ids = kept.select("_id").distinct()
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    several = found.groupBy(F.col("doc_id").alias("_id")).count().where(F.col("count") > 1)
    several = checkpointed(spark, several.select("_id"))
    if several.isEmpty():
        return rows
    once = rows.join(several, rows["doc_id"].eqNullSafe(several["_id"]), "left_anti")
    # An id does not tell which of its rows stay; their fingerprints do.
    again = with_print(rows.join(several, rows["doc_id"].eqNullSafe(several["_id"]), "left_semi"))
    again = again.join(kept, again["doc_id"].eqNullSafe(kept["_id"]) & (again["_fp"] == kept["_print"]))
    nameless = again.where(F.col("doc_id").isNull()).select(docs.columns)
    named = again.where(F.col("doc_id").isNotNull()).dropDuplicates(["_node"]).select(docs.columns)
    return once.unionByName(named).unionByName(nameless)
