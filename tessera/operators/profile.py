"""Column kinds, column types and normalization reports in one pass over the cells."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.naming import header_forms
from tessera.functions.normalize import DIGIT_COUNTS, INTEGER_TEXT, KIND_TYPES, normalize, numeric_class
from tessera.functions.temporal import iso_calendar_date, parse_timestamp, with_moments
from tessera.functions.text import digits, is_blank, strip
from tessera.operators.cells import ROW, melt
from tessera.session import checkpointed, small

# Parts of a header that hint at a kind.
DATE_HINTS = ("data", "nasc", "venc", "exped")
TIMESTAMP_HINTS = ("timestamp", "hora", "horario", "createdat", "updatedat")
PHONE_HINTS = ("telefone", "celular", "fone", "whatsapp", "contato")

KEYS = ["dataset", "column"]


def _is_iso_date() -> Column:
    """Strict ISO dates; a text in the extended form was already parsed."""
    text, tag, size = F.col("text"), F.col("tag"), F.length("text")
    extended = (size == 10) & text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    unusual = text.contains("W") | ((size == 8) & (F.col("only") == 8))
    return (
        F.when(tag.isin("date", "datetime"), True)
        .when((tag != "str") | ~size.isin(7, 8, 10), False)
        .when(extended, F.col("moment.ts").isNotNull() & ~text.startswith("0000"))
        .when(unusual, iso_calendar_date(text).isNotNull())
        .otherwise(False)
    )


def _flags() -> dict[str, Column]:
    """What is recorded about a cell, one bit each."""
    text, tag, size = F.col("text"), F.col("tag"), F.col("only")
    filled = F.col("filled")
    number = numeric_class(text)
    flags = {
        "present": tag != "null",
        "filled": filled,
        "parsed": filled & F.col("moment.ts").isNotNull(),
        "timed": filled & F.coalesce(F.col("moment.has_time"), F.lit(False)),
        "bool": tag == "bool",
        "int": tag == "int",
        "float": tag == "float",
        "integer_text": (tag == "str") & (number == "BIGINT"),
        "decimal_text": (tag == "str") & (number == "DOUBLE"),
        "iso": _is_iso_date(),
        # Only an integer that long can be beyond 64 bits.
        "too_big": (size > 18) & text.rlike(INTEGER_TEXT) & text.try_cast("bigint").isNull(),
        "telefone": filled & (size > 0),
        "phone_like": filled & (size >= 4) & ~text.contains("@"),
    }
    return flags | {kind: filled & (size == count) for kind, count in DIGIT_COUNTS.items()}


FLAGS = (
    "present filled parsed timed bool int float integer_text decimal_text iso too_big telefone phone_like cpf cnpj cep"
).split()
BITS = {name: 1 << place for place, name in enumerate(FLAGS)}


def _measured(cells: DataFrame) -> DataFrame:
    """``[dataset, column, mask]``; each text is parsed exactly once, here."""
    text = F.col("text")
    # Blank spellings never parse, so the moments need no guard.
    parsed = with_moments(cells.select(*KEYS, "text", "tag"), {"moment": text})
    staged = parsed.withColumns({"filled": ~is_blank(text), "only": F.length(digits(text))})
    bits = [F.when(flag, BITS[name]).otherwise(0) for name, flag in _flags().items()]
    return staged.select(*KEYS, reduce(add, bits).alias("mask"))


def column_facts(cells: DataFrame) -> DataFrame:
    """One row per (dataset, column): everything kinds, types and reports need.

    Cells are first counted by their mask. A column has a handful of distinct
    masks, so the counting is one cheap hash aggregation whose map side leaves
    almost nothing to shuffle; all further facts come from those few rows.
    """
    counted = _measured(cells).groupBy(*KEYS, "mask").agg(F.count("*").alias("n"))

    def has(*names: str) -> Column:
        wanted = sum(BITS[name] for name in names)
        return F.col("mask").bitwiseAND(F.lit(wanted)) != 0

    def cells_with(name: str) -> Column:
        return F.coalesce(F.sum(F.when(has(name), F.col("n"))), F.lit(0))

    def every(*names: str) -> Column:
        """Over non-NULL cells; an empty column answers true and is caught earlier."""
        return F.coalesce(F.bool_and(F.when(has("present"), has(*names))), F.lit(True))

    return counted.groupBy(*KEYS).agg(
        F.sum("n").alias("n_rows"),
        cells_with("present").alias("n_present"),
        cells_with("filled").alias("n_filled"),
        cells_with("parsed").alias("n_parsed"),
        F.bool_or(has("timed")).alias("any_time"),
        *[cells_with(kind).alias(f"n_{kind}") for kind in (*DIGIT_COUNTS, "telefone", "phone_like")],
        every("bool").alias("all_bool"),
        every("int").alias("all_int"),
        every("int", "float").alias("all_number"),
        every("integer_text", "decimal_text").alias("all_numeric_text"),
        every("integer_text").alias("all_integer_text"),
        every("iso").alias("all_iso"),
        F.bool_or(has("too_big")).alias("too_big"),
    )


def _mentions(flat: Column, hints: tuple[str, ...]) -> Column:
    return flat.rlike("|".join(hints))


def kind_of(column: Column) -> Column:
    """The kind of a column from its header and its facts; first match wins."""
    forms = header_forms(column)
    flat, spaced = forms["flat"], forms["spaced"]
    filled = F.col("n_filled")
    all_parsed = F.col("n_parsed") == filled
    dated = _mentions(flat, DATE_HINTS) | spaced.startswith("dt_")
    all_phone = F.col("n_phone_like") == filled
    return (
        F.when(filled == 0, F.lit(None).cast("string"))
        .when(all_parsed & (F.col("any_time") | _mentions(flat, TIMESTAMP_HINTS)), "timestamp")
        .when(dated & (F.col("n_parsed") > 0) & ~F.col("any_time"), "date")
        .when(all_parsed, "date")
        .when(flat.contains("cpf") & ~flat.contains("cnpj") & (F.col("n_cpf") == filled), "cpf")
        .when(flat.contains("cnpj") & (F.col("n_cnpj") == filled), "cnpj")
        .when(flat.contains("cep") & (F.col("n_cep") == filled), "cep")
        .when(_mentions(flat, PHONE_HINTS) & all_phone, "telefone")
    )


def plain_type() -> Column:
    """The stored type of a column without a kind; only NULL cells are skipped."""
    return (
        F.when(F.col("n_present") == 0, F.lit("VARCHAR"))
        .when(F.col("all_bool"), "BOOLEAN")
        .when(F.col("all_int"), "BIGINT")
        .when(F.col("all_number"), "DOUBLE")
        .when(F.col("all_numeric_text") & F.col("all_integer_text"), "BIGINT")
        .when(F.col("all_numeric_text"), "DOUBLE")
        .when(F.col("all_iso"), "DATE")
        .otherwise("VARCHAR")
    )


def decided(facts: DataFrame) -> DataFrame:
    kind_types = F.create_map(*[F.lit(v) for pair in KIND_TYPES.items() for v in pair])
    with_kind = facts.withColumn("kind", kind_of(F.col("column")))
    typed = with_kind.withColumn(
        "type", F.coalesce(F.try_element_at(kind_types, F.col("kind")), plain_type())
    )
    kept = F.lit(None).cast("bigint")
    for kind in KIND_TYPES:
        measure = "n_parsed" if kind in ("date", "timestamp") else f"n_{kind}"
        kept = F.when(F.col("kind") == kind, F.col(measure)).otherwise(kept)
    return (
        typed.withColumn("normalized", kept)
        .withColumn("nulled", F.col("n_filled") - F.col("normalized"))
        .withColumn("overflow", F.col("too_big") & (F.col("type") == "BIGINT"))
    )


def profile(cells: DataFrame) -> DataFrame:
    """``[dataset, column, type, kind, row_count, normalized, nulled, overflow]``."""
    return decided(column_facts(cells)).select(
        *KEYS, "type", "kind", F.col("n_rows").alias("row_count"), "normalized", "nulled", "overflow"
    )


def detect_kinds(cells: DataFrame) -> DataFrame:
    return profile(cells).select(*KEYS, "kind")


def infer_types(cells: DataFrame) -> DataFrame:
    return profile(cells).select(*KEYS, "type")


def normalized_text(text: Column, kind: Column) -> Column:
    """A cell in canonical text form by a kind held in a column; raw without one."""
    result = F.when(kind.isNull(), text)
    for name in DIGIT_COUNTS:
        result = result.when(kind == name, normalize(text, name))
    result = result.when(kind == "telefone", normalize(text, "telefone"))
    full = F.date_format(parse_timestamp(text), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return result.otherwise(full.substr(F.lit(1), F.when(kind == "date", 10).otherwise(26)))


def _earliest(keep: int, places: list[str]):
    """A task's work: of each column the ``keep`` different texts that come first, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for key, text, *place in zip(*(batch.column(c).to_pylist() for c in ("_key", "example", *places))):
                place, texts = tuple(place), held.setdefault(key, {})
                if text in texts:
                    texts[text] = min(texts[text], place)
                elif len(texts) < keep:
                    texts[text] = place
                elif place < max(texts.values()):
                    del texts[max(texts, key=texts.get)]
                    texts[text] = place
        rows = [(key, text, *place) for key, texts in held.items() for text, place in texts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def earliest_lost(cells: DataFrame, kinds: DataFrame, keep: int = 3) -> DataFrame:
    """``[_key, example, places...]``: at most ``keep`` lost texts of a column from each task, the first ones."""
    known = small(kinds.filter("kind is not null and nulled > 0").select(*KEYS, "kind"))
    filled = cells.join(known, KEYS).filter(~is_blank(F.col("text")))
    lost = filled.filter(normalized_text(F.col("text"), F.col("kind")).isNull())
    kind = cells.schema[ROW].dataType
    places = {f"_at{n}": F.col(f"{ROW}.{field.name}") for n, field in enumerate(kind.fields)} if isinstance(kind, T.StructType) else {"_at0": F.col(ROW)}
    listed = lost.select(F.to_json(F.struct(*KEYS)).alias("_key"), F.substring(strip(F.col("text")), 1, 40).alias("example"), *(c.cast("bigint").alias(n) for n, c in places.items()))
    return listed.mapInArrow(_earliest(keep, list(places)), listed.schema)


def nulled_examples(cells: DataFrame, kinds: DataFrame, keep: int = 3) -> DataFrame:
    """First distinct lost texts per column: ``[dataset, column, rank, example]``.

    Every task keeps the first ``keep`` different texts of a column while it reads,
    so a column that loses billions of cells, all of them different, shuffles at
    most ``keep`` rows per task.
    """
    found = earliest_lost(cells, kinds, keep)
    places = [c for c in found.columns if c.startswith("_at")]
    lost = found.groupBy("_key", "example").agg(F.min(F.struct(*places)).alias("first_row"))
    ranked = lost.withColumn("rank", F.row_number().over(W.partitionBy("_key").orderBy("first_row"))).filter(F.col("rank") <= keep)
    keys = T.StructType([cells.schema[c] for c in KEYS])
    return ranked.withColumn("_of", F.from_json("_key", keys)).select(*(F.col(f"_of.{c}").alias(c) for c in KEYS), "rank", "example")


def normalization_report(cells: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Per normalized column: counts and up to three lost texts."""
    kinds = checkpointed(cells.sparkSession, profile(cells)) if kinds is None else kinds
    ranked = nulled_examples(cells, kinds)
    shown = ranked.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("rank") == n, F.col("example"))).alias(f"example_{n}") for n in (1, 2, 3)]
    )
    return (
        kinds.filter("kind is not null")
        .select(*KEYS, "kind", "type", "normalized", "nulled")
        .join(shown, KEYS, "left")
    )


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows in source order: a top-n per task, never a full sort."""
    return df.orderBy(ROW).limit(n)


def profile_table(df: DataFrame, columns: list[str] | None = None, dataset: str = "") -> DataFrame:
    return profile(melt(df, columns, dataset))
