"""Kinds, types, reports and naming over whole columns."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.naming import RESERVED, sanitize, unique_names
from tessera.functions.text import BLANK_TOKENS
from tessera.operators.cells import ROW, melt
from tessera.operators.profile import (
    DATE_HINTS,
    PHONE_HINTS,
    TIMESTAMP_HINTS,
    detect_kinds,
    first_rows,
    infer_types,
    normalization_report,
    normalized_text,
    profile,
)
from tessera.plans.store import typed_table
from tessera.session import spread
from tessera.workload.inputs import CLEAN_ORDERS, MESSY_COLUMNS, ORACLE_MESSY, messy_orders, run
from tessera.workload.registry import query

_BLANKS = ", ".join(f"'{token}'" for token in BLANK_TOKENS)
_DAYS = ("%d/%m/%Y", "%Y-%m-%d", "%d-%m-%y", "%Y/%m/%d", "%d.%m.%Y")
_PARSED = "coalesce(" + ", ".join(f"try_strptime(c, '{f}')" for f in (*_DAYS, "%d/%m/%Y %H:%M")) + ")"
_ONLY = "length(regexp_replace(c, '[^0-9]', '', 'g'))"
_NUMBER = r"'[-+]?(0|[1-9][0-9]*)'"
_DECIMAL = r"'[-+]?(0|[1-9][0-9]*)[.][0-9]+'"


def _facts(columns: list[str]) -> str:
    """Oracle facts per column; dates are parsed by format here, not by pattern."""
    parts = [
        f"SELECT '{name}' AS \"column\", {name} AS c, k FROM messy" for name in columns
    ]
    return f"""
    WITH messy AS ({ORACLE_MESSY}), cells AS ({' UNION ALL '.join(parts)}),
    marked AS (SELECT *, c IS NOT NULL AND lower(trim(c)) NOT IN ({_BLANKS}) AS filled, {_PARSED} AS m,
      try_strptime(c, '%d/%m/%Y %H:%M') IS NOT NULL AS timed, {_ONLY} AS n FROM cells),
    facts AS (SELECT "column", count(*) AS n_rows, count(c) AS n_present,
      count_if(filled) AS n_filled, count_if(filled AND m IS NOT NULL) AS n_parsed, bool_or(filled AND timed) AS any_time,
      count_if(filled AND n = 11) AS n_cpf, count_if(filled AND n = 14) AS n_cnpj, count_if(filled AND n = 8) AS n_cep,
      count_if(filled AND n > 0) AS n_telefone, count_if(filled AND n >= 4 AND NOT contains(c, '@')) AS n_phone,
      bool_and(c IS NULL OR regexp_full_match(c, {_NUMBER})) AS all_int,
      bool_and(c IS NULL OR regexp_full_match(c, {_NUMBER}) OR regexp_full_match(c, {_DECIMAL})) AS all_num,
      bool_and(c IS NULL OR try_strptime(c, '%Y-%m-%d') IS NOT NULL) AS all_iso
      FROM marked GROUP BY "column"),
    kinds AS (SELECT *, CASE WHEN n_filled = 0 THEN NULL
      WHEN n_parsed = n_filled AND (any_time OR {_like(TIMESTAMP_HINTS)}) THEN 'timestamp'
      WHEN ({_like(DATE_HINTS)} OR "column" LIKE 'dt!_%' ESCAPE '!') AND n_parsed > 0 AND NOT any_time THEN 'date'
      WHEN n_parsed = n_filled THEN 'date'
      WHEN contains("column", 'cpf') AND NOT contains("column", 'cnpj') AND n_cpf = n_filled THEN 'cpf'
      WHEN contains("column", 'cnpj') AND n_cnpj = n_filled THEN 'cnpj'
      WHEN contains("column", 'cep') AND n_cep = n_filled THEN 'cep'
      WHEN {_like(PHONE_HINTS)} AND n_phone = n_filled THEN 'telefone' END AS kind FROM facts),
    typed AS (SELECT *, CASE WHEN kind = 'date' THEN 'DATE' WHEN kind = 'timestamp' THEN 'TIMESTAMP'
      WHEN kind IS NOT NULL OR n_present = 0 THEN 'VARCHAR' WHEN all_int THEN 'BIGINT' WHEN all_num THEN 'DOUBLE'
      WHEN all_iso THEN 'DATE' ELSE 'VARCHAR' END AS type,
      CASE kind WHEN 'date' THEN n_parsed WHEN 'timestamp' THEN n_parsed WHEN 'cpf' THEN n_cpf WHEN 'cnpj' THEN n_cnpj
        WHEN 'cep' THEN n_cep WHEN 'telefone' THEN n_telefone END AS normalized FROM kinds)
    """


def _like(hints) -> str:
    return "(" + " OR ".join(f"contains(replace(\"column\", '_', ''), '{hint}')" for hint in hints) + ")"


FACTS = _facts(MESSY_COLUMNS)


def cells(spark, sf_dir):
    return melt(spread(messy_orders(spark, sf_dir).withColumnRenamed("k", ROW)), MESSY_COLUMNS, "orders")


@query("detect_column_kind", f'{FACTS} SELECT "column", kind FROM typed')
def kinds(spark, sf_dir):
    return detect_kinds(cells(spark, sf_dir)).drop("dataset")


@query("infer_column_types", f'{FACTS} SELECT "column", type FROM typed')
def types(spark, sf_dir):
    return infer_types(cells(spark, sf_dir)).drop("dataset")


@query(
    "normalization_report",
    f"""{FACTS}, lost AS (SELECT "column", substr(trim(c), 1, 40) AS example, min(k) AS first_row
      FROM marked JOIN typed USING ("column") WHERE filled AND m IS NULL AND kind IN ('date', 'timestamp') GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY first_row) AS rank FROM lost)
    SELECT "column", kind, type, normalized, n_filled - normalized AS nulled,
      max(CASE WHEN rank = 1 THEN example END) AS example_1, max(CASE WHEN rank = 2 THEN example END) AS example_2,
      max(CASE WHEN rank = 3 THEN example END) AS example_3
    FROM typed LEFT JOIN ranked USING ("column") WHERE kind IS NOT NULL GROUP BY ALL""",
)
def report(spark, sf_dir):
    return normalization_report(cells(spark, sf_dir)).drop("dataset")


@query(
    "profile_dataset",
    f"""{FACTS}, shown AS (SELECT "column", string_agg(coalesce(c, 'NULL'), ';' ORDER BY k) AS raw_sample
      FROM cells WHERE k < 5 GROUP BY "column")
    SELECT "column", type, kind, n_rows AS row_count, normalized, n_filled - normalized AS nulled, raw_sample
    FROM typed JOIN shown USING ("column")""",
)
def profiled(spark, sf_dir):
    whole = cells(spark, sf_dir)
    sample = first_rows(messy_orders(spark, sf_dir).withColumnRenamed("k", ROW))
    shown = (
        melt(sample, MESSY_COLUMNS, "orders")
        .groupBy("dataset", "column")
        .agg(F.array_sort(F.collect_list(F.struct(ROW, F.coalesce("text", F.lit("NULL")).alias("text")))).alias("s"))
        .select("dataset", "column", F.array_join("s.text", ";").alias("raw_sample"))
    )
    return profile(whole).drop("overflow").join(shown, ["dataset", "column"]).drop("dataset")


@query(
    "sample_first_five",
    f"SELECT k, strftime(data_pedido, '%Y-%m-%d') AS data_pedido, strftime(registro, '%Y-%m-%d %H:%M:%S.%f') AS registro, "
    f"cpf, cep, telefone, codigo FROM ({CLEAN_ORDERS}) c ORDER BY k LIMIT 5",
)
def sample(spark, sf_dir):
    """The five-row preview of a proposal, normalized by the kinds of whole columns."""
    df = messy_orders(spark, sf_dir).withColumnRenamed("k", ROW)
    known = {r.column: r.kind for r in detect_kinds(cells(spark, sf_dir)).collect()}
    shown = [
        normalized_text(F.col(c), F.lit(known[c]).cast("string")).alias(c)
        for c in ("data_pedido", "registro", "cpf", "cep", "telefone", "codigo")
    ]
    return first_rows(df).select(F.col(ROW).alias("k"), *shown)


@query("row_count", "SELECT 'orders' AS dataset, count(*) AS row_count FROM orders")
def row_count(spark, sf_dir):
    return messy_orders(spark, sf_dir).agg(F.count("*").alias("row_count")).select(F.lit("orders").alias("dataset"), "row_count")


@query("typed_cast", f"SELECT * FROM ({CLEAN_ORDERS}) c")
def typed_cast(spark, sf_dir):
    df = spread(messy_orders(spark, sf_dir).withColumnRenamed("k", ROW))
    found = {r.column: r for r in profile(melt(df, MESSY_COLUMNS)).collect()}
    decided = [(found[c].type, found[c].kind) for c in MESSY_COLUMNS]
    return typed_table(df, MESSY_COLUMNS, MESSY_COLUMNS, decided).withColumnRenamed(ROW, "k")


OVERFLOW = """
SELECT o_orderkey AS k, cast(o_custkey + 1 AS varchar(20)) || '00000000000000000001' AS wide,
  cast(o_custkey AS varchar(20)) AS narrow,
  CASE WHEN o_orderkey % 2 = 0 THEN '9223372036854775807' ELSE '-9223372036854775808' END AS edge FROM orders
"""


@query(
    "bigint_overflow_check",
    f"""WITH t AS ({OVERFLOW}) SELECT 'wide' AS "column", 'BIGINT' AS type, bool_or(try_cast(wide AS bigint) IS NULL) AS overflow FROM t
    UNION ALL SELECT 'narrow', 'BIGINT', bool_or(try_cast(narrow AS bigint) IS NULL) FROM t
    UNION ALL SELECT 'edge', 'BIGINT', bool_or(try_cast(edge AS bigint) IS NULL) FROM t""",
)
def overflow(spark, sf_dir):
    df = run(spark, sf_dir, OVERFLOW).withColumnRenamed("k", ROW)
    return profile(melt(df, ["wide", "narrow", "edge"])).select("column", "type", "overflow")


# Labels from part names; every third part has a colliding spelling.
LABELS = """
SELECT p_size AS file, p_partkey AS pos,
  CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || ' (é)' WHEN 2 THEN ' ' || replace(p_name, ' ', '--') || '!'
    ELSE cast(p_size AS varchar(9)) || ' ' || p_type END AS label
FROM part
"""

SLUG = (
    "CASE WHEN regexp_matches(s, '^[0-9]') THEN 'col_' || s WHEN s = '' THEN 'unnamed' ELSE s END"
)
SLUGGED = f"""
SELECT file, pos, label, {SLUG} AS slug FROM (SELECT *,
  trim(regexp_replace(lower(strip_accents(label)), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM ({LABELS}) l) x
"""


@query("sanitize_identifier", f"SELECT pos, slug FROM ({SLUGGED}) s")
def sanitized(spark, sf_dir):
    return run(spark, sf_dir, LABELS).select("pos", sanitize(F.col("label")).alias("slug"))


@query(
    "unique_identifiers",
    f"""SELECT file, pos, CASE WHEN rn = 1 THEN slug ELSE slug || '_' || cast(rn AS varchar) END AS name
    FROM (SELECT *, row_number() OVER (PARTITION BY file, slug ORDER BY pos) AS rn FROM ({SLUGGED}) s) r""",
)
def unique(spark, sf_dir):
    labels = run(spark, sf_dir, LABELS).withColumn("slug", sanitize(F.col("label")))
    return unique_names(labels, ["file"], "slug", "pos", RESERVED).select("file", "pos", "name")


@query(
    "exclude_formula_columns",
    "SELECT o_orderkey AS k, o_custkey AS customer, o_totalprice AS price FROM orders",
)
def excluded(spark, sf_dir):
    from tessera.plans.store import Dataset, stored_columns

    source = "SELECT o_orderkey AS k, o_custkey AS customer, o_totalprice AS price, o_totalprice * 2 AS twice FROM orders"
    df = run(spark, sf_dir, source)
    return df.select(*stored_columns(Dataset("orders", df, formula_columns=("twice",))))


@query(
    "table_naming",
    """WITH pairs AS (SELECT p_partkey AS pos, 'Supplier ' || cast(p_size AS varchar) AS source_name, p_brand || ' ' || p_type AS dataset_name FROM part),
    base AS (SELECT pos, trim(regexp_replace(lower(source_name), '[^a-z0-9]+', '_', 'g'), '_') || '__' ||
      trim(regexp_replace(lower(dataset_name), '[^a-z0-9]+', '_', 'g'), '_') AS base FROM pairs)
    SELECT pos, CASE WHEN rn = 1 THEN base ELSE base || '_' || cast(rn AS varchar) END AS table_name
    FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) AS rn FROM base) r""",
)
def named_tables(spark, sf_dir):
    source = (
        "SELECT p_partkey AS pos, 'Supplier ' || cast(p_size AS varchar(9)) AS source_name, "
        "p_brand || ' ' || p_type AS dataset_name FROM part"
    )
    base = F.concat_ws("__", sanitize(F.col("source_name")), sanitize(F.col("dataset_name")))
    named = unique_names(run(spark, sf_dir, source).select("pos", base.alias("base")), [], "base", "pos")
    return named.select("pos", F.col("name").alias("table_name"))
