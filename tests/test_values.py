from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions.naming import distinct_names, identifier, ranked, sanitize, unique_identifiers, unique_names
from tessera.functions.normalize import normalize, numeric_class
from tessera.functions.temporal import iso_calendar_date, parse_temporal, with_moments
from tessera.functions.text import is_blank

MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()


def spellings(day, month, year):
    """Every accepted way to write a day."""
    name = MONTHS[month - 1]
    full = [f"{year}-{month:02}-{day:02}", f"{year}-{month}-{day}", f"{year}/{month:02}/{day:02}"]
    for mark in "/-.":
        full += [f"{day:02}{mark}{month:02}{mark}{year}", f"{day}{mark}{month}{mark}{year}", f"{day:02}{mark}{month:02}{mark}{year % 100:02}"]
    full += [f"{day} de {name} de {year}", f"{day} DE {name.upper()} DE {year}", f"{day:02}/{name[:3]}/{year}", f"{day:02}.{name[:3]}.{year % 100:02}"]
    return [(text, datetime(year, month, day), False) for text in full]


CLOCKS = [("07:08", (7, 8)), ("23:59:58", (23, 59, 58)), ("00:00:00.125", (0, 0, 0, 125000))]
OFFSETS = [("Z", 0), ("+00:00", 0), ("-03:00", 180), ("+0545", -345), ("-11:30", 690)]
NO_MOMENTS = [
    None, "", " ", "-", "n/a", "nada consta", "30/02/2031", "2031-13-01", "31/04/2030", "00/01/2030", "11/xyz/2031",
    "5 de maio", "2031-05-06T25:00", "2031-05-06T12:60", "2031-05-06T12:00:61", "2031-05-06T12:00:00+25:00",
    "2031-05-06 7:8", "05/06/2031t12:00", "05/jun/2031 12:00z", "2031/06/5", "0111/06/2031", "9999-12-31T22:00-05:00",
]

TEMPORAL = [
    *spellings(19, 3, 2031),
    *spellings(1, 12, 2024),
    *spellings(29, 2, 2028),
    *[(f"2031-05-06{mark}{clock}", datetime(2031, 5, 6, *parts), True) for mark in "T " for clock, parts in CLOCKS],
    *[(f"06/05/2031 {clock}", datetime(2031, 5, 6, *parts), True) for clock, parts in CLOCKS],
    *[(f"2031-05-06T12:00:00{text}", datetime(2031, 5, 6, 12) + timedelta(minutes=m), True) for text, m in OFFSETS],
    *[(text, None, None) for text in NO_MOMENTS],
    # Tolerated: spaces and dots around, a month name that only begins right, a year below 100, a longer day.
    ("  2031-05-06.. ", datetime(2031, 5, 6), False),
    ("6 de maixyz de 2031", datetime(2031, 5, 6), False),
    ("0031-05-06", datetime(2031, 5, 6), False),
    ("006/05/2031", datetime(2031, 5, 6), False),
    ("06/mai/2031t12:00", datetime(2031, 5, 6, 12), True),
]


def test_parse_temporal_both_forms(spark):
    df = spark.createDataFrame([(n, text) for n, (text, _, _) in enumerate(TEMPORAL)], "n int, text string")
    staged = with_moments(df, {"m": F.col("text")}).select("n", "m.ts", "m.has_time")
    single = df.withColumn("m", parse_temporal(F.col("text"))).select("n", "m.ts", "m.has_time")
    for found in (staged, single):
        got = {r.n: (r.ts, r.has_time) for r in found.collect()}
        for n, (text, ts, flag) in enumerate(TEMPORAL):
            assert got[n] == (ts, flag), text


CELLS = [
    # Digits are kept if there are as many as the kind has.
    *[(text, kind, "".join(c for c in text if c.isdigit())) for text, kind in (
        ("314.159.265-35", "cpf"), ("000.000.001-91", "cpf"), ("31415926535", "cpf"),
        ("27.182.818/2845-90", "cnpj"), ("27182818284590", "cnpj"), ("16180-339", "cep"), ("00000-001", "cep"),
    )],
    *[(text, kind, None) for text, kind in (("314.159.265-3", "cpf"), ("27.182.818/2845-901", "cnpj"), ("1618-0339-8", "cep"))],
    # Phones with an area get the country in front; local ones stay.
    ("(48) 3131-4242", "telefone", "554831314242"),
    ("48 98765-4321", "telefone", "5548987654321"),
    ("+55 48 98765 4321", "telefone", "5548987654321"),
    ("3131-4242", "telefone", "31314242"),
    *[(blank, kind, None) for blank in (None, " ", "--") for kind in ("cpf", "cnpj", "cep", "telefone", "date", "timestamp")],
    ("19.3.2031", "date", date(2031, 3, 19)),
    ("2031-03-19", "date", date(2031, 3, 19)),
    ("a combinar", "date", None),
    ("19/03/2031 07:08", "timestamp", datetime(2031, 3, 19, 7, 8)),
    ("19/03/2031", "timestamp", datetime(2031, 3, 19)),
    ("2031-03-19T22:30:00-03:00", "timestamp", datetime(2031, 3, 20, 1, 30)),
]


@pytest.mark.parametrize("kind", sorted({kind for _, kind, _ in CELLS}))
def test_normalize(spark, kind):
    cases = [(text, value) for text, k, value in CELLS if k == kind]
    df = spark.createDataFrame([(n, text) for n, (text, _) in enumerate(cases)], "n int, text string")
    got = df.select("n", normalize(F.col("text"), kind).alias("v")).orderBy("n").collect()
    assert [r.v for r in got] == [value for _, value in cases]


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        normalize(F.lit("x"), "placa")


def test_blank_and_numbers(spark):
    texts = ["", " - ", "--", "S/ Data", "N/A", "none", None, "—", "0", "0012", "+5", "-1.50", "1e3", " 1", "1."]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    rows = df.select(is_blank(F.col("t")).alias("b"), numeric_class(F.col("t")).alias("c")).collect()
    assert [r.b for r in rows] == [True] * 7 + [False] * 8
    assert [r.c for r in rows][8:] == ["BIGINT", None, "BIGINT", "DOUBLE", None, None, None]


def test_iso_calendar_date(spark):
    cases = {
        "20260902": date(2026, 9, 2), "2026-09-02": date(2026, 9, 2), "2026-W36-3": date(2026, 9, 2),
        "2026W363": date(2026, 9, 2), "2026-W36": date(2026, 8, 31), "2026-W54": None, "2020W53": date(2020, 12, 28),
        "2021W53": None, "2026-02-30": None, "2026-9-2": None, "2026-09-02 ": None, "02/09/2026": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.d for r in df.select("t", iso_calendar_date(F.col("t")).alias("d")).collect()} == cases


LABELS = ["Área 1 (Notas)", "", "A B", "A-B", "1º lugar", "ß", "a_b_2", "source_id", "ﬁm", "--", "a b"]


def test_identifiers(spark):
    assert identifier("Área 1 (Notas)") == "area_1_notas"
    assert identifier("") == "unnamed"
    assert identifier("1 x") == "col_1_x"
    df = spark.createDataFrame([(n, t) for n, t in enumerate(LABELS)], "n int, t string")
    got = [r.s for r in df.select("n", sanitize(F.col("t")).alias("s")).orderBy("n").collect()]
    assert got == [identifier(label) for label in LABELS]
    assert unique_identifiers(["A B", "A-B", "source_id"]) == ["a_b", "a_b_2", "source_id_2"]
    assert distinct_names(["a", "a", "a_2", "a"]) == ["a", "a_2", "a_2_2", "a_3"]


def test_unique_names_matches_the_driver_form(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for scope in range(12):
        pool = ["a", "b", "a_2", "c_3", "a_2_2", "source_id"][: rnd.randrange(1, 7)]
        rows += [(scope, pos, rnd.choice(pool)) for pos in range(rnd.randrange(1, 40))]
    df = spark.createDataFrame(rows, "scope int, pos int, base string")
    got = {(r.scope, r.pos): r.name for r in unique_names(df, ["scope"], "base", "pos", ["source_id"]).collect()}
    for scope in range(12):
        own = [(pos, base) for s, pos, base in rows if s == scope]
        wanted = distinct_names([base for _, base in own], ["source_id"])
        assert [got[scope, pos] for pos, _ in own] == wanted


def test_unique_names_of_chained_endings(spark):
    """Bases that look like numbered forms of each other, over taken names given as a table."""
    import random

    rnd = random.Random(8)
    pool = ["a", "a_2", "a_3", "a_4", "a_2_2", "a_2_3", "a_2_2_2", "a_10", "b", "b_2", "b_02", "b_1", "c_2"]
    rows = [(scope, pos, rnd.choice(pool[: 4 + scope])) for scope in range(9) for pos in range(60)]
    rows += [(None, pos, "a" if pos % 3 else f"a_{pos}") for pos in range(200)]  # one family, each third row a number of it
    df = spark.createDataFrame(rows, "scope int, pos int, base string")
    taken = ["a_5", "b", "b_3", "a_2_4", "zz"]
    table = spark.createDataFrame([(x, 1) for x in taken], "name string, pos int")
    named = unique_names(df, ["scope"], "base", "pos", table)
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert named.columns == [*df.columns, "name"] and "Python" not in plan and "Pandas" not in plan
    got = {(r.scope, r.pos): r.name for r in named.collect()}
    for scope in [*range(9), None]:
        own = [(pos, base) for s, pos, base in rows if s == scope]
        assert [got[scope, pos] for pos, _ in own] == distinct_names([base for _, base in own], taken)


def test_ranked_splits_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    rows = ranked(df.repartition(7), ["k"], "id").filter("k = 'hot'").orderBy("id").collect()
    assert [r._rank for r in rows] == list(range(1, len(rows) + 1))
