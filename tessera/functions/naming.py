"""Identifiers made from free-form labels."""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpointed

# Columns that say where a row came from.
PROVENANCE = (
    ("source_id", "VARCHAR"),
    ("source_page", "BIGINT"),
    ("source_section", "VARCHAR"),
    ("source_sheet", "VARCHAR"),
)
RESERVED = tuple(name for name, _ in PROVENANCE)


def identifier(label: str) -> str:
    """``Área 1 (Notas)`` -> ``area_1_notas``; for lists the driver already holds."""
    folded = unicodedata.normalize("NFKD", label).encode("ascii", "ignore").decode("ascii")
    return _finish(folded)


def _finish(folded: str) -> str:
    words = re.findall("[a-z0-9]+", folded.lower())
    name = "_".join(words) or "unnamed"
    return f"col_{name}" if name[0] in "0123456789" else name


@F.pandas_udf(T.StringType())
def _ascii_fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKD has no built-in; the fold is vectorized over Arrow batches."""
    for labels in batches:
        yield labels.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def sanitize(label: Column) -> Column:
    """Column form of :func:`identifier` for tables of labels."""
    words = F.trim(F.regexp_replace(F.lower(_ascii_fold(label)), "[^a-z0-9]+", " "))
    name = F.when(words == "", F.lit("unnamed")).otherwise(F.translate(words, " ", "_"))
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("col_"), name)).otherwise(name)


def distinct_names(bases: Iterable[str], taken: Iterable[str] = ()) -> list[str]:
    """Every base in turn gets the first name of ``base, base_2, base_3, ...`` nobody holds yet; for short lists."""
    holders = dict.fromkeys(taken)
    for place, base in enumerate(bases):
        spellings = chain([base], (f"{base}_{n}" for n in count(2)))
        holders[next(name for name in spellings if name not in holders)] = place
    return [name for name, place in holders.items() if place is not None]


def unique_identifiers(labels: Iterable[str], taken: Iterable[str] = RESERVED) -> list[str]:
    return distinct_names([identifier(label) for label in labels], taken)


def unique_names(df: DataFrame, scope: list[str], base: str, order: str, taken: Iterable[str] | DataFrame = ()) -> DataFrame:
    """Distributed form of :func:`distinct_names` within each ``scope``: adds ``name``.

    The n-th member of a base gets number n, plus one for each number below that
    it finds in use. A number k of base ``a`` is in use if ``a_k`` is taken, or is
    a base itself that came before the member who would get it: these contested
    numbers, and nothing else, are settled by joins on (base, place) and counted in
    running sums over ranges. ``a_k`` in its turn finds its own name in use if that
    member came first, so bases are settled in the order of their endings.

    ``taken`` may be a table, whose first column is read. ``order`` tells all rows
    of a scope apart.
    """
    spark = df.sparkSession
    if isinstance(taken, DataFrame):
        held = taken.select(F.col(taken.columns[0]).cast("string").alias("_held")).distinct()
    else:
        held = spark.createDataFrame([(name,) for name in sorted(set(taken))], "_held string")
    keys = [*scope, "_base"]
    members = ranked(df.withColumn("_base", F.col(base)), keys, order)
    bases = members.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(order).alias("_at"))
    bases = bases.join(held, F.col("_base") == F.col("_held"), "left")
    bases = checkpointed(spark, bases.withColumn("_late", F.when(F.col("_held").isNotNull(), 1).otherwise(0)).drop("_held"))

    def numbered(name: str) -> list[Column]:
        ending = r"\A(.+)_([1-9][0-9]{0,17})\z"
        return [F.regexp_extract(name, ending, 1).alias("_base"), F.regexp_extract(name, ending, 2).try_cast("bigint").alias("_k")]

    literal = bases.select(*scope, F.col("_base").alias("_self"), "_at", (F.col("_late") == 1).alias("_always"))
    literal = literal.select(*scope, "_self", "_at", "_always", *numbered("_self"))
    reserved = held.select(*numbered("_held")).join(bases.select(*keys).distinct(), "_base")
    contested = literal.unionByName(reserved.withColumn("_always", F.lit(True)).dropDuplicates([*keys, "_k"]), allowMissingColumns=True)
    # A number may come as a base and as a taken name; the latter decides.
    contested = contested.where("_k >= 2").groupBy(*keys, "_k").agg(F.max("_self").alias("_self"), F.min("_at").alias("_at"), F.max("_always").alias("_always"))
    several = bases.where("_n > 1 OR _late = 1 OR _base RLIKE '_[0-9]+$'").select(*keys)
    contested = checkpointed(spark, _same(contested, several, keys, "left_semi"))
    numbers = members.withColumn("_shift", F.lit(0).cast("bigint"))
    if not contested.isEmpty():
        members = checkpointed(spark, members)
        skipped, bases = _settled(spark, scope, members, bases, contested, order)
        numbers = _shifted(members, bases, skipped, keys)
    named = _same(numbers, bases.select(*keys, "_late"), keys, "inner")
    number = F.col("_rank") + F.col("_late") + F.col("_shift")
    name = F.when(number == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), number.cast("string")))
    return named.withColumn("name", name).select(*df.columns, "name")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on equal keys, nulls too, that keeps the columns of the left side and new ones of the right."""
    other = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    met = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys))
    return left.join(other, met, how).drop(*(f"_r_{c}" for c in keys))


def _settled(spark, scope, members, bases, contested, order) -> tuple[DataFrame, DataFrame]:
    """The contested numbers that are skipped, and ``bases`` with all that find their own name in use marked."""
    keys = [*scope, "_base"]
    found, left = None, contested
    while not left.isEmpty():
        # Bases whose own name is still open wait for the one whose ending is shorter.
        open_ = left.where("_self IS NOT NULL").select(*scope, F.col("_self").alias("_base")).distinct()
        now = checkpointed(spark, _same(_same(left, open_, keys, "left_anti"), bases.select(*keys, "_late"), keys, "inner"))
        left = checkpointed(spark, _same(left, open_, keys, "left_semi"))
        now = now.withColumn("_skip", F.lit(1))
        places = members.select(*keys, F.col("_rank").alias("_place"), F.col(order).alias("_by"))
        while True:
            counted = running(now, keys, ["_k"], "_skip", "_upto").drop("_by", "_place")
            counted = counted.withColumn("_place", F.col("_k") - (F.col("_upto") - F.col("_skip")) - F.col("_late"))
            met = _same(counted, places, [*keys, "_place"], "left")
            skip = F.when(F.col("_always") | F.col("_by").isNull() | (F.col("_at") < F.col("_by")), 1).otherwise(0)
            met = checkpointed(spark, met.withColumn("_now", skip))
            same = met.where("_now <> _skip").isEmpty()
            now = met.withColumn("_skip", F.col("_now")).drop("_now", "_upto")
            if same:
                break
        found = now if found is None else found.unionByName(now)
        late = now.where("_skip = 0 AND _self IS NOT NULL").select(*scope, F.col("_self").alias("_base"), F.lit(1).alias("_now"))
        bases = _same(bases, late, keys, "left").withColumn("_late", F.greatest("_late", F.coalesce("_now", F.lit(0)))).drop("_now")
        bases = checkpointed(spark, bases)
    return found.where("_skip = 1").select(*keys, "_k", "_skip"), bases


def _shifted(members, bases, skipped, keys) -> DataFrame:
    """``members`` with ``_shift``, how many skipped numbers lie below the one they get."""
    ranks = running(skipped, keys, ["_k"], "_skip", "_m")
    # The m-th skipped number s moves all members on whose number without it would be s - m + 1 or more.
    steps = ranks.select(*keys, (F.col("_k") - F.col("_m") + 1).alias("_number"), F.lit(1).alias("_step"))
    own = _same(members, bases.select(*keys, "_late"), keys, "inner").withColumn("_number", F.col("_rank") + F.col("_late")).drop("_late")
    both = own.withColumn("_step", F.lit(0)).unionByName(steps, allowMissingColumns=True).withColumn("_back", -F.col("_step"))
    return running(both, keys, ["_number", "_back"], "_step", "_shift").where("_step = 0").drop("_number", "_step", "_back")


def running(df: DataFrame, keys: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row within ``keys`` by ``order``, without one task per key.

    Rows are range partitioned by key and order, so a key that holds a third of
    all rows spreads over many partitions. Each partition sums up its own rows and
    adds what the same key has in earlier partitions: one number per pair.
    The partitioned rows are checkpointed, so that a repeated task sees them
    where they were.
    """
    parted = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    parted = checkpointed(df.sparkSession, parted)
    sums = parted.groupBy("_part", *keys).agg(F.sum(value).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_part", *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    upto = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = parted.withColumn("_local", F.sum(value).over(upto))
    return _same(local, offsets, ["_part", *keys], "inner").withColumn(into, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def ranked(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``_rank`` within ``keys`` by ``order``, however many rows a key has."""
    return running(df.withColumn("_one", F.lit(1)), keys, [order], "_one", "_rank").drop("_one")


def header_forms(label: Column) -> Column:
    """``struct(flat, spaced)``: letters and digits only, and the ``dt_`` form."""
    lowered = F.lower(label)
    return F.struct(
        F.regexp_replace(lowered, "[^a-z0-9]", "").alias("flat"),
        F.regexp_replace(F.trim(lowered, F.lit("_")), "[^a-z0-9]+", "_").alias("spaced"),
    )
