"""Cell normalizers over texts written from the orders table."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions.naming import header_forms
from tessera.functions.temporal import iso_calendar_date, with_moments
from tessera.functions.text import BLANK_TOKENS, is_blank
from tessera.workload.inputs import MONTH_ABBREV, MONTH_NAME, run
from tessera.workload.registry import query

DAY = "cast(o_orderdate AS timestamp)"
CENTURY = "cast(make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) AS timestamp)"
NONE = "cast(NULL AS timestamp)"


def _case(*branches: str) -> str:
    listed = " ".join(f"WHEN {n} THEN {branch}" for n, branch in enumerate(branches))
    return f"CASE o_orderkey % {len(branches)} {listed} END"


def temporal(name: str, *cases: tuple[str, str, str]) -> None:
    """Register a parser query; each case is (text, expected value, has time)."""
    texts, values, flags = zip(*cases)
    source = f"SELECT o_orderkey AS k, {_case(*texts)} AS text FROM orders"
    sql = f"SELECT o_orderkey AS k, {_case(*values)} AS ts, {_case(*flags)} AS has_time FROM orders"

    @query(name, sql)
    def parsed(spark, sf_dir):
        return with_moments(run(spark, sf_dir, source), {"m": F.col("text")}).select("k", "m.ts", "m.has_time")


def at(hours: int, minutes: int, seconds: float = 0, base: str = DAY) -> str:
    micros = round((hours * 3600 + minutes * 60 + seconds) * 1_000_000)
    return f"{base} + to_microseconds({micros})"


ISO = [
    ("{{yyyy-MM-dd}}", DAY, "false"),
    ("{{yyyy-M-d}}", DAY, "false"),
    ("'  ' || {{yyyy-MM-dd}} || ' 9:05 '", at(9, 5), "true"),
    ("{{yyyy-MM-dd}} || 'T14:30:15.250'", at(14, 30, 15.25), "true"),
    ("{{yyyy-MM-dd}} || 'x'", NONE, "NULL"),
]
DAY_FIRST = [
    ("{{dd/MM/yyyy}}", DAY, "false"),
    ("{{d.M-yyyy}}", DAY, "false"),
    ("{{dd-MM-yyyy}} || '.'", DAY, "false"),
    ("{{dd/MM/yyyy}} || ' 14:30:15.5'", at(14, 30, 15.5), "true"),
]
YEAR_FIRST = [("{{yyyy/MM/dd}}", DAY, "false"), ("{{yyyy.MM/dd}} || ' 23:59'", at(23, 59), "true")]
SHORT_YEAR = [
    ("{{dd-MM-yy}}", CENTURY, "false"),
    ("{{dd/MM}} || '/0' || {{yy}}", CENTURY, "false"),
    ("'00' || {{yy-MM-dd}}", CENTURY, "false"),
]
MONTHS = [
    (f"{{{{dd}}}} || '/' || {MONTH_ABBREV} || '/' || {{{{yyyy}}}}", DAY, "false"),
    (f"{{{{d}}}} || '.' || upper({MONTH_ABBREV}) || '.' || {{{{yy}}}} || ' 08:15'", at(8, 15, base=CENTURY), "true"),
    (f"{{{{dd}}}} || '-' || {MONTH_NAME} || '/' || {{{{yyyy}}}}", DAY, "false"),
    ("{{dd}} || '/xyz/' || {{yyyy}}", NONE, "NULL"),
]
WRITTEN = [
    (f"{{{{d}}}} || ' de ' || {MONTH_NAME} || ' de ' || {{{{yyyy}}}}", DAY, "false"),
    (f"{{{{dd}}}} || ' DE ' || upper({MONTH_NAME}) || ' DE ' || {{{{yyyy}}}}", DAY, "false"),
    (f"{{{{d}}}} || ' de ' || {MONTH_NAME}", NONE, "NULL"),
    (f"{{{{d}}}} || ' de ' || {MONTH_ABBREV} || '. de ' || {{{{yyyy}}}} || '.'", DAY, "false"),
]
CLOCK = [
    ("{{dd/MM/yyyy}} || ' 7:05'", at(7, 5), "true"),
    ("{{yyyy-MM-dd}} || 'T00:00'", DAY, "true"),
    ("{{dd.MM.yyyy}} || ' 23:59:59.999999'", at(23, 59, 59.999999), "true"),
    ("{{yyyy/MM/dd}}", DAY, "false"),
    ("{{dd/MM/yyyy}} || ' 7:5'", NONE, "NULL"),
]
OFFSETS = [
    ("{{yyyy-MM-dd}} || 'T14:30:00Z'", at(14, 30), "true"),
    ("{{yyyy-MM-dd}} || 'T14:30:00-04:00'", at(18, 30), "true"),
    ("{{dd/MM/yyyy}} || ' 02:00 +0530'", f"{DAY} - to_minutes(210)", "true"),
    ("{{yyyy-MM-dd}} || 'T10:00:00+24:00'", NONE, "NULL"),
    ("{{yyyy-MM-dd}} || ' 10:00 +05:99'", at(3, 21), "true"),
]
IMPOSSIBLE = [
    ("'31/02/' || {{yyyy}}", NONE, "NULL"),
    ("{{yyyy-MM-dd}} || ' 24:00'", NONE, "NULL"),
    ("{{yyyy-MM-dd}} || ' 10:00:60'", NONE, "NULL"),
    ("{{yyyy}} || '-13-' || {{dd}}", NONE, "NULL"),
    ("{{dd/MM/yyyy}}", DAY, "false"),
    ("'—'", NONE, "NULL"),
    ("cast(NULL AS varchar(1))", NONE, "NULL"),
]

temporal("parse_iso", *ISO)
temporal("parse_day_first", *DAY_FIRST)
temporal("parse_year_first", *YEAR_FIRST)
temporal("two_digit_year", *SHORT_YEAR)
temporal("parse_month_name", *MONTHS)
temporal("parse_written_date", *WRITTEN)
temporal("parse_time_suffix", *CLOCK)
temporal("offset_to_utc", *OFFSETS)
temporal("invalid_calendar_null", *IMPOSSIBLE)

EVERY = [*ISO, *DAY_FIRST, *YEAR_FIRST, *SHORT_YEAR, *MONTHS, *WRITTEN, *CLOCK, *OFFSETS, *IMPOSSIBLE]
temporal("parse_temporal", *EVERY)

ANY_TEXT = f"SELECT o_orderkey AS k, {_case(*[text for text, _, _ in EVERY])} AS text FROM orders"
ANY_VALUE = _case(*[value for _, value, _ in EVERY])


@query("normalize_date", f"SELECT o_orderkey AS k, cast({ANY_VALUE} AS date) AS value FROM orders")
def normalize_date(spark, sf_dir):
    return run(spark, sf_dir, ANY_TEXT).select("k", N.normalize(F.col("text"), "date").alias("value"))


@query("normalize_timestamp", f"SELECT o_orderkey AS k, {ANY_VALUE} AS value FROM orders")
def normalize_timestamp(spark, sf_dir):
    return run(spark, sf_dir, ANY_TEXT).select("k", N.normalize(F.col("text"), "timestamp").alias("value"))


DIGITS = "lpad(cast(o_custkey * 7919 + o_orderkey AS varchar(20)), 14, '0')"


def documents(kind: str, *cases: tuple[str, str]) -> None:
    texts, values = zip(*cases)
    source = f"SELECT o_orderkey AS k, {_case(*texts)} AS text FROM (SELECT *, {DIGITS} AS n FROM orders) x"
    sql = f"SELECT o_orderkey AS k, {_case(*values)} AS value FROM (SELECT *, {DIGITS} AS n FROM orders) x"

    @query("normalize_phone" if kind == "telefone" else f"normalize_{kind}", sql)
    def normalized(spark, sf_dir):
        return run(spark, sf_dir, source).select("k", N.normalize(F.col("text"), kind).alias("value"))


EMPTY = [("'s/ data'", "NULL"), ("''", "NULL"), ("cast(NULL AS varchar(1))", "NULL")]
documents(
    "cpf",
    ("substr(n, 4, 3) || '.' || substr(n, 7, 3) || '.' || substr(n, 10, 3) || '-' || substr(n, 13, 2)", "substr(n, 4)"),
    ("substr(n, 4)", "substr(n, 4)"),
    ("substr(n, 5)", "NULL"),
    *EMPTY,
)
documents(
    "cnpj",
    ("substr(n, 1, 2) || '.' || substr(n, 3, 3) || '.' || substr(n, 6, 3) || '/' || substr(n, 9, 4) || '-' || substr(n, 13)", "n"),
    ("'CNPJ ' || n", "n"),
    ("n || '1'", "NULL"),
    *EMPTY,
)
documents(
    "cep",
    ("substr(n, 7, 5) || '-' || substr(n, 12)", "substr(n, 7)"),
    ("substr(n, 8)", "NULL"),
    *EMPTY,
)
documents(
    "telefone",
    ("'(11) ' || substr(n, 7, 4) || '-' || substr(n, 11)", "'5511' || substr(n, 7)"),
    ("'11 9' || substr(n, 7)", "'55119' || substr(n, 7)"),
    ("'+55 (11) 9' || substr(n, 7, 4) || '-' || substr(n, 11)", "'55119' || substr(n, 7)"),
    ("substr(n, 7, 4) || '-' || substr(n, 11)", "substr(n, 7)"),
    ("'nenhum'", "NULL"),
    *EMPTY,
)

_TOKENS = [f"'{token}'" for token in BLANK_TOKENS]
_BLANK_CASES = [
    *[(token, "true") for token in _TOKENS],
    ("'  N/A '", "true"),
    ("cast(NULL AS varchar(1))", "true"),
    ("'—'", "false"),
    ("o_orderpriority", "false"),
    ("'n/a ' || o_orderstatus", "false"),
]


@query("is_blank", f"SELECT o_orderkey AS k, {_case(*[v for _, v in _BLANK_CASES])} AS blank FROM orders")
def blank(spark, sf_dir):
    source = f"SELECT o_orderkey AS k, {_case(*[t for t, _ in _BLANK_CASES])} AS text FROM orders"
    return run(spark, sf_dir, source).select("k", is_blank(F.col("text")).alias("blank"))


@query(
    "normalize_idempotent",
    "SELECT kind, count(*) AS n_rows, cast(0 AS bigint) AS n_changed FROM orders "
    "CROSS JOIN (VALUES ('date'), ('timestamp'), ('cpf'), ('cnpj'), ('cep'), ('telefone')) t(kind) GROUP BY kind",
)
def idempotent(spark, sf_dir):
    """Normalizing the printed result of a normalization changes nothing."""
    texts = [t for t, _, _ in EVERY] + ["n", "substr(n, 4)", "'(11) ' || substr(n, 7)", "substr(n, 7)", "'+55 11 9' || substr(n, 7)"]
    source = f"SELECT o_orderkey AS k, {_case(*texts)} AS text FROM (SELECT *, {DIGITS} AS n FROM orders) x"
    df = run(spark, sf_dir, source)
    changed = []
    for kind in N.KIND_TYPES:
        once = N.normalize(F.col("text"), kind)
        again = N.normalize(once.cast("string"), kind)
        changed.append(F.struct(F.lit(kind).alias("kind"), (~once.eqNullSafe(again)).alias("differs")))
    return df.select(F.inline(F.array(*changed))).groupBy("kind").agg(
        F.count("*").alias("n_rows"), F.count_if("differs").alias("n_changed")
    )


LABEL = "'Horário de ' || p_name || ' (' || p_brand || ') Ç' || cast(p_partkey AS varchar(20))"


@query(
    "normalize_header",
    f"""SELECT p_partkey AS k, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS flat,
    regexp_replace(trim(lower(label), '_'), '[^a-z0-9]+', '_', 'g') AS spaced
    FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN {LABEL} ELSE '_DT ' || {LABEL} END AS label FROM part) x""",
)
def header(spark, sf_dir):
    source = f"SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN {LABEL} ELSE '_DT ' || {LABEL} END AS label FROM part"
    forms = header_forms(F.col("label"))
    return run(spark, sf_dir, source).select("k", forms["flat"].alias("flat"), forms["spaced"].alias("spaced"))


_NUMBERS = [
    ("cast(o_custkey AS varchar(20))", "'BIGINT'"),
    ("'-' || cast(o_custkey + 1 AS varchar(20))", "'BIGINT'"),
    ("'+' || cast(cast(o_totalprice AS decimal(18, 2)) AS varchar(30))", "'DOUBLE'"),
    ("'0' || cast(o_custkey AS varchar(20))", "CASE WHEN o_custkey < 0 THEN 'BIGINT' END"),
    ("cast(o_custkey AS varchar(20)) || 'e3'", "NULL"),
    ("' ' || cast(o_custkey AS varchar(20))", "NULL"),
    ("'0.50'", "'DOUBLE'"),
    ("'1.'", "NULL"),
]


@query("numeric_string_class", f"SELECT o_orderkey AS k, {_case(*[v for _, v in _NUMBERS])} AS class FROM orders")
def numeric(spark, sf_dir):
    source = f"SELECT o_orderkey AS k, {_case(*[t for t, _ in _NUMBERS])} AS text FROM orders"
    return run(spark, sf_dir, source).select("k", N.numeric_class(F.col("text")).alias("class"))


_ISO_DATES = [
    ("{{yyyy-MM-dd}}", "cast(o_orderdate AS date)"),
    ("{{yyyyMMdd}}", "cast(o_orderdate AS date)"),
    ("{{yyyy}} || '-02-30'", "cast(NULL AS date)"),
    ("{{dd/MM/yyyy}}", "cast(NULL AS date)"),
    # The Monday of week 10, which always lies inside its own year.
    ("{{yyyy}} || '-W10'", "cast(date_trunc('week', make_date(year(o_orderdate), 1, 4)) AS date) + 63"),
    ("{{yyyy}} || 'W107'", "cast(date_trunc('week', make_date(year(o_orderdate), 1, 4)) AS date) + 69"),
    ("{{yyyy}} || '-W54'", "cast(NULL AS date)"),
]


@query("iso_date_cell", f"SELECT o_orderkey AS k, {_case(*[v for _, v in _ISO_DATES])} AS value FROM orders")
def iso_date(spark, sf_dir):
    source = f"SELECT o_orderkey AS k, {_case(*[t for t, _ in _ISO_DATES])} AS text FROM orders"
    return run(spark, sf_dir, source).select("k", iso_calendar_date(F.col("text")).alias("value"))
