"""Cell normalizers, one per semantic kind."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.temporal import iso_calendar_date, parse_date, parse_timestamp
from tessera.functions.text import digits

# Semantic kind -> stored type name.
KIND_TYPES = {
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "cpf": "VARCHAR",
    "cnpj": "VARCHAR",
    "cep": "VARCHAR",
    "telefone": "VARCHAR",
}

# Digits in a document number or postal code.
DIGIT_COUNTS = {"cpf": 11, "cnpj": 14, "cep": 8}

# Stored type name -> Spark type.
SPARK_TYPES = {
    "BOOLEAN": "boolean",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "VARCHAR": "string",
}

INTEGER_TEXT = r"\A[-+]?(?:0|[1-9][0-9]*)\z"
DECIMAL_TEXT = r"\A[-+]?(?:0|[1-9][0-9]*)[.][0-9]+\z"


def normalize(text: Column, kind: str) -> Column:
    """The cell in canonical form, NULL when it cannot be recovered."""
    if kind == "date":
        return parse_date(text)
    if kind == "timestamp":
        return parse_timestamp(text)
    if kind == "telefone":
        return _phone(text)
    if kind in DIGIT_COUNTS:
        only = digits(text)
        return F.when(F.length(only) == DIGIT_COUNTS[kind], only)
    raise ValueError(f"unknown normalization kind: {kind!r}")


def _phone(text: Column) -> Column:
    only = digits(text)
    size = F.length(only)
    return F.when(size.isin(10, 11), F.concat(F.lit("55"), only)).when(size > 0, only)


def numeric_class(text: Column) -> Column:
    """``BIGINT`` or ``DOUBLE`` for a plainly written number, else NULL.

    Leading zeros, exponents and blanks make a text a label, not a number.
    """
    return F.when(text.rlike(INTEGER_TEXT), F.lit("BIGINT")).when(
        text.rlike(DECIMAL_TEXT), F.lit("DOUBLE")
    )


def typed(text: Column, type_name: str, kind: str | None = None) -> Column:
    """One cell's text as the value to store in a column of the decided type."""
    if kind is not None:
        return normalize(text, kind)
    if type_name == "DATE":
        # Native datetimes print with a time of day; only the day is stored.
        return F.coalesce(iso_calendar_date(text), F.to_date(parse_timestamp(text)))
    if type_name == "VARCHAR":
        return text
    return text.try_cast(SPARK_TYPES[type_name])
