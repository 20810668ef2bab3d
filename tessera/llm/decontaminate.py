"""Benchmark items found in documents: SimHash windows, Hamming blocks, exact check.

An item of n words is held against every run of n words of a document (the whole
document if it has fewer). Item and window are bags of five-word shingles (the
whole sequence if there are fewer words), and the item is in the document if the
weighted Jaccard similarity of the bags, the weight of a shingle being how often
it occurs, reaches ``SIMILARITY`` in some window.

1. A window without an exact shingle of the item has similarity 0. A window that
   reaches s lacks less than (1-s) of the item's shingles, so some of any
   ``floor((1-s)m)+1`` of its m distinct ones, counted with weight, must occur.
   The rarest in the benchmark are taken as the item's anchors, looked up while
   documents are scanned, and each names its items: only windows that hold an
   anchor of an item are looked at, and with this item only. This drops no window
   that can qualify.
2. Those windows get SimHash fingerprints. Bits of all hashes are summed in 32
   words of two lanes as running sums over the document, so a window of any
   length is a difference of two rows.
3. Fingerprints are cut into ``RADIUS``+1 blocks; those within ``RADIUS`` bits of
   an item agree with it in a block at least, so of the pairs that met by an
   anchor those with an equal block, and among them those within the radius, go on.
4. What is left is compared shingle by shingle, on the words themselves.

Items with equal words are one until the end, when each gets its row.

Everything is DataFrame expressions. At similarity 0.8 two fingerprints are some
10 of 64 bits apart, with a deviation below 3, so the radius of 19 misses less
than one in a thousand windows right at the threshold, and an item is missed
only if all windows that reach it are.

Defined results: words are runs of anything but white space (space and 9 to 13)
with A-Z lower-cased; null or wordless texts and items match nothing; repeated
rows with one id are one document, whose windows stay within each text; ties of
the best window go to the earliest; other columns are ignored.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpointed, small

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
#: Anchors up to which they are sent to every executor (a row is three numbers); more are joined by a shuffle.
SMALL = 200_000

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LANES = range(32)


def words(text):
    """The words of a text column; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), CAPITALS, CAPITALS.lower())
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingled(array: str, size: str, shingle: str) -> str:
    """SQL for what ``shingle`` makes of each run ``x`` of ``size`` words, in order; none if there are fewer."""
    runs = f"CASE WHEN size({array}) >= {size} THEN sequence(1, size({array}) - {size} + 1) ELSE array() END"
    return f"transform({runs}, i -> {shingle.replace('{x}', f'slice({array}, i, {size})')})"


JOINED = "array_join({x}, ' ')"
HASHED = "xxhash64({x})"


def items_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``item, n, k, m, w, shingles``: texts of n words as m shingles of k words, each once; and ``item, item_id``."""
    split = benchmark.select("item_id", words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    split = split.select("item_id", "w", F.unhex(F.md5(F.array_join("w", " "))).alias("item"))  # words hold no spaces
    sized = split.select("item", "w").dropDuplicates(["item"]).withColumn("n", F.size("w")).withColumn("k", F.least(F.lit(SHINGLE), "n"))
    texts = sized.select("item", "n", "k", (F.col("n") - F.col("k") + 1).alias("m"), "w", F.expr(shingled("w", "k", JOINED)).alias("shingles"))
    return texts, split.select("item", "item_id").distinct()


def anchors_of(items: DataFrame) -> DataFrame:
    """``h, n, k, items``: hashes of which every window that can reach an item of n words holds one, and their items."""
    runs = items.select("item", "n", "k", "m", F.explode(F.expr(shingled("w", "k", HASHED))).alias("h"))
    rows = runs.groupBy("item", "n", "k", "m", "h").agg(F.count("*").alias("weight"))
    shared = rows.groupBy("h", "k").agg(F.count("*").alias("shared"))
    before = Window.partitionBy("item").orderBy("shared", "h").rowsBetween(Window.unboundedPreceding, -1)
    # The common weight is at least s times all, so a window lacks at most (1-s)m of the item's.
    kept = rows.join(shared, ["h", "k"]).withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    kept = kept.where(F.col("before") <= F.floor((1 - SIMILARITY) * F.col("m") + 1e-9))
    return kept.groupBy("h", "n", "k").agg(F.collect_set("item").alias("items"))


def lane(h, k: int):
    """Bits k and k+32 of a hash in the two halves of one word."""
    return F.shiftrightunsigned(h, k).bitwiseAND(F.lit(0x0000000100000001).cast("bigint"))


def fingerprint(sums, m):
    """64 bits, each set where over half of ``m`` hashes have it."""
    low = F.lit(0xFFFFFFFF).cast("bigint")
    halves = [(sums[k].bitwiseAND(low), k) for k in LANES] + [(F.shiftrightunsigned(sums[k], 32), k + 32) for k in LANES]
    bits = [F.shiftleft((2 * count > m).cast("bigint"), at) for count, at in halves]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def blocks(fp):
    """``RADIUS``+1 blocks of 3 or 4 bits, each with its number."""
    count, parts, at = RADIUS + 1, [], 0
    for i in range(count):
        width = 64 // count + (i < 64 % count)
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        parts.append(value + (i << 8))
        at += width
    return F.array(*parts)


def row_of():
    """Names a row of the documents; rows that are equal in id and text are one."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))


def around_anchors(docs: DataFrame, anchors: DataFrame, sizes: list[int]) -> DataFrame:
    """``row, n, k, mw, first, last, items, w``: where windows of n words begin that hold an anchor, their words, the anchor's items.

    ``mw`` is the number of shingles of a window in this row.
    """
    split = docs.select(row_of().alias("row"), words(F.col("text").cast("string")).alias("w"))
    hashes = F.concat(*(F.expr(shingled("w", str(k), f"struct({k} AS k, i - 1 AS pos, {HASHED} AS h)")) for k in sizes))
    found = split.select("row", "w", F.explode(hashes).alias("x")).select("row", "w", "x.k", "x.pos", "x.h")
    # A document shorter than the item is one window.
    mw = F.least(F.col("n"), F.size("w")) - F.col("k") + 1
    return (
        found.join(anchors, ["h", "k"])
        .select("row", "w", "n", "k", "items", mw.alias("mw"), F.greatest(F.lit(0), F.col("pos") - mw + 1).alias("first"),
                F.least(F.col("pos"), F.greatest(F.size("w") - F.col("n"), F.lit(0))).alias("last"))
        .where("first <= last")
        .select("row", "n", "k", "mw", "first", "last", "items", F.expr("slice(w, first + 1, last - first + mw + k - 1)").alias("w"))
    )


def shingles_of(near: DataFrame) -> DataFrame:
    """``row, n, mw, pos, shingle, starts``: each shingle of the windows, and whether one of them starts with it."""
    rows = near.select("row", "n", "mw", "first", "last", F.posexplode(F.expr(shingled("w", "k", JOINED))).alias("i", "shingle"))
    pos = F.col("first") + F.col("i")
    rows = rows.select("row", "n", "mw", pos.alias("pos"), "shingle", (pos <= F.col("last")).alias("starts"))
    # Everything that follows works on the shingles of one row around anchors: dealt out once.
    return rows.repartition("row", "n").groupBy("row", "n", "mw", "pos", "shingle").agg(F.max("starts").alias("starts"))


def candidates(near: DataFrame) -> DataFrame:
    """``row, n, start, item``: windows with the items of which they hold an anchor."""
    found = near.select("row", "n", "first", "last", F.explode("items").alias("item"))
    return found.select("row", "n", "item", F.explode(F.sequence("first", "last")).alias("start")).distinct()


def fingerprints(near: DataFrame) -> DataFrame:
    """``row, n, mw, start, fp`` of the windows that start in ``near``."""
    order = Window.partitionBy("row", "n").orderBy("pos")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = near.withColumn("h", F.xxhash64("shingle"))
    lanes = {f"s{k}": lane(F.col("h"), k) for k in LANES}
    summed = hashed.select("row", "n", "mw", "pos", "starts", *(v.alias(f"x{c[1:]}") for c, v in lanes.items()))
    summed = summed.select("*", *(F.sum(f"x{k}").over(run).alias(f"s{k}") for k in LANES))
    begin = F.struct(F.col("pos").alias("start"), F.col("starts").alias("real"), *((F.col(f"x{k}") - F.col(f"s{k}")).alias(f"s{k}") for k in LANES))
    end = F.struct((F.col("pos") - F.col("mw") + 1).alias("start"), F.lit(False).alias("real"), *(F.col(f"s{k}") for k in LANES))
    edges = summed.select("row", "n", "mw", F.explode(F.array(begin, end)).alias("e")).select("row", "n", "mw", "e.*")
    both = edges.groupBy("row", "n", "mw", "start").agg(F.max("real").alias("real"), F.count("*").alias("edges"), *(F.sum(f"s{k}").alias(f"s{k}") for k in LANES))
    whole = both.where(F.col("real") & (F.col("edges") == 2))
    return whole.select("row", "n", "mw", "start", fingerprint([F.col(f"s{k}") for k in LANES], F.col("mw")).alias("fp"))


def tagged(bag: str) -> str:
    """SQL that makes the repeats in a bag distinct, so that bags can be held against each other as sets.

    The arrays of one element bind what they hold to a name, so that it is made once.
    """
    repeats = "transform(s, (x, i) -> CASE WHEN array_position(s, x) = i + 1 THEN x ELSE concat(x, ' ', i + 1 - array_position(s, x)) END)"
    repeats = f"transform(array(array_sort(p)), s -> {repeats})[0]"
    return f"transform(array({bag}), p -> CASE WHEN size(array_distinct(p)) = size(p) THEN p ELSE {repeats} END)[0]"


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``row, item, start, similarity`` of every window within the radius that reaches an item of ``items_of``."""
    spark = docs.sparkSession
    items = checkpointed(spark, items)
    sizes = [r["k"] for r in items.select("k").distinct().orderBy("k").collect()] or [SHINGLE]  # at most SHINGLE values
    anchors = small(checkpointed(spark, anchors_of(items)), SMALL)
    near = checkpointed(spark, around_anchors(docs, anchors, sizes))
    shingles = shingles_of(near)
    spread = items.withColumn("bag", F.expr(tagged("shingles"))).select("item", "n", "m", "bag", F.explode("shingles").alias("shingle"))
    sums = (F.sum(lane(F.xxhash64("shingle"), k)).alias(f"s{k}") for k in LANES)
    summed = spread.groupBy("item", "n", "m", "bag").agg(*sums)
    item_fp = fingerprint([F.col(f"s{k}") for k in LANES], F.col("m"))
    known = small(checkpointed(spark, summed.select("item", "n", "m", "bag", item_fp.alias("item_fp"), blocks(item_fp).alias("item_blocks"))), SMALL)
    windows = fingerprints(shingles).withColumn("blocks", blocks(F.col("fp")))
    close = (
        windows.join(candidates(near), ["row", "n", "start"])
        .join(known, ["item", "n"])
        .where(F.arrays_overlap("blocks", "item_blocks") & (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS))
        .select("row", "n", "mw", "start", "item", "m", "bag")
    )
    regions = shingles.groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "shingle"))).alias("region"))
    part = F.expr("slice(region.shingle, array_position(region.pos, start), mw)")
    held = close.join(regions, ["row", "n"]).select("row", "item", "start", "m", "mw", "bag", part.alias("part"))
    held = held.select("row", "item", "start", "m", "mw", F.size(F.array_intersect(F.expr(tagged("part")), "bag")).alias("c"))
    return held.select("row", "item", "start", (F.col("c") / (F.col("m") + F.col("mw") - F.col("c"))).alias("similarity")).where(F.col("similarity") >= SIMILARITY)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity, start, n_windows``: the items found in each document.

    ``start`` is the first word of the best window, ``n_windows`` counts those
    that reach the similarity.
    """
    items, ids = items_of(benchmark)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    found = matches(docs, items).groupBy(F.col("row.id").alias("doc_id"), "item").agg(best.alias("best"), F.count("*").alias("n_windows"))
    found = found.join(ids, "item").groupBy("doc_id", "item_id").agg(F.max("best").alias("best"), F.sum("n_windows").alias("n_windows"))
    return found.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"), "n_windows")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    found = matches(docs, items_of(benchmark)[0]).select("row.id", "row.text").distinct()
    same = F.col("doc_id").eqNullSafe(found["id"]) & (F.xxhash64(docs["text"]) == found["text"])
    return docs.join(found, same, "left_anti")
