"""What each of several filters removes, alone and in every order, by a Gray-code walk over their subsets.

1. Every document becomes the mask of the filters it fails, in one scan of its
   whole text. Copies are found by SHA-256 of the text: a document fails the copy
   filter if a smaller id has the same digest.
2. Masks are counted by part (with how many of them are labelled good and toxic),
   so what leaves the scan is a cell for each part and mask.
3. In each part the subsets of filters are walked in Gray order. A step switches
   one filter on or off: the cells that fail it count one active failure more or
   less, and those that leave or reach zero leave or join the running survivors.
   The survivors of all ``2**k`` subsets are kept; everything asked about an
   order is a difference of two of them.

Defined results: a null text is empty; a null part is the empty one; repeated rows
count each; a null id is neither smaller nor larger than any other, so it is no
copy and makes none; a document is good (toxic) if any label row of its id says
1, unlabelled and null ids are neither; an empty table has no parts; other
columns are ignored.
"""
from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpointed

SPACES = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The filter that ``masks`` works out over the whole table.
COPIES = "E"
LETTERS = "ABCDE"

MEASURES = "n", "good", "toxic"
ROWS = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def failures(text: Column) -> dict[str, Column]:
    """The conditions on a single text under which it fails."""
    bare = F.btrim(text, F.lit(SPACES))
    # The array of one element binds the words to a name, so that they are made once.
    counts = F.transform(F.array(F.split(bare, r"[\x20\x09-\x0D]+")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    n = F.when(bare == "", 0).otherwise(F.col("_words.n"))
    distinct = F.when(bare == "", 0).otherwise(F.col("_words.distinct"))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "_words": counts,
        "A": n < 100,
        "B": 100 * distinct < 80 * n,
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``id, part, mask`` of every row of ``docs``; bit i of the mask is set if it fails filter i of ``LETTERS``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    conditions = failures(F.col("text"))
    rows = rows.withColumn("_words", conditions.pop("_words"))
    own = sum((F.when(condition, 1 << LETTERS.index(name)).otherwise(0) for name, condition in conditions.items()), F.lit(0))
    # Texts are read once; what goes on has no text in it.
    rows = checkpointed(spark, rows.select("id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")))
    several = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1 AND least IS NOT NULL")
    # A join of two tables, one with a row for each digest, can be split where a text is frequent.
    several = checkpointed(spark, several.select("digest", "least"))
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return rows.join(several, "digest", "left").select("id", "part", (F.col("own") + F.when(copy, 1 << LETTERS.index(COPIES)).otherwise(0)).alias("mask"))


def cells(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents have a mask, and how many of them are labelled so."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    one = one.agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    sums = (F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))
    return found.join(one, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)


def survivors(mask: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """For each subset of ``k`` filters, by its bits, the sums of ``counts`` over the cells that fail none of it."""
    out = np.zeros((1 << k, counts.shape[1]), np.int64)
    active_failures = np.zeros(len(mask), np.int64)
    running, active = counts.sum(axis=0), 0
    out[0] = running
    for step in range(1, 1 << k):
        bit = step & -step  # the one in which this Gray code differs from the one before
        active ^= bit
        fails = mask & bit != 0
        if active & bit:
            running = running - counts[fails & (active_failures == 0)].sum(axis=0)
            active_failures[fails] += 1
        else:
            active_failures[fails] -= 1
            running = running + counts[fails & (active_failures == 0)].sum(axis=0)
        out[active] = running
    return out


def orders(states: np.ndarray, letters: Sequence[str]) -> list[tuple]:
    """``filter_order, step`` and the figures of ``ROWS`` for every order of the filters."""
    k = len(letters)
    everything, total = (1 << k) - 1, states[0]
    # A subset of size s stands before a filter in s! (k-1-s)! orders.
    shapley = [
        sum(
            factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * int(states[s][0] - states[s | 1 << f][0])
            for s in range(1 << k)
            if not s >> f & 1
        )
        for f in range(k)
    ]
    out = []
    for order in permutations(range(k)):
        name, active = "".join(letters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = active | 1 << f
            gone = states[active] - states[after]
            failing = total[0] - states[1 << f][0]
            alone = states[everything ^ 1 << f][0] - states[everything][0]
            out.append((name, step, states[after][0], gone[0], failing - gone[0], alone, gone[1], gone[2], shapley[f]))
            active = after
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row of ``ROWS`` for each part, order of the filters and step."""
    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()) for name, kind in (x.split() for x in ROWS.split(", "))])

    def walk(table: pa.Table) -> pa.Table:
        counts = np.stack([np.asarray(table.column(c)) for c in MEASURES], axis=1)
        rows = orders(survivors(np.asarray(table.column("mask")), counts, len(LETTERS)), LETTERS)
        name = table.column("part")[0].as_py()
        columns = zip(*((name, *row) for row in rows))
        return pa.Table.from_arrays([pa.array([x if isinstance(x, str) else int(x) for x in c], f.type) for c, f in zip(columns, schema)], schema=schema)

    return cells(masks(docs, part), labels).groupBy("part").applyInArrow(walk, ROWS)
