import pytest
from pyspark.sql import functions as F

from tessera.operators.cells import ROW, melt
from tessera.operators.profile import detect_kinds, infer_types, normalization_report, profile

# One line per rule: what the header says, what the cells say, what wins.
DAYS = ["17/11/2031", "4.7.2030"]
MOMENTS = ["17/11/2031 06:05", "2030-07-04T23:59:01"]
ELEVEN, FOURTEEN, EIGHT = "31415926535", "27182818284590", "16180339"

KINDS = [
    # Cells that are all moments: with a time, or under a header that means one.
    ("x", DAYS, "date"),
    ("x", MOMENTS, "timestamp"),
    ("x", [DAYS[0], MOMENTS[0]], "timestamp"),
    *[(name, DAYS, "timestamp") for name in ("Horario", "Updated At", "hora_extra", "TIMESTAMP")],
    ("Horário", DAYS, "date"),
    # A header that means a date is enough if one cell is, and none has a time.
    *[(name, [DAYS[0], "a combinar"], "date") for name in ("Vencimento", "nascido/nasc.", "expedição", "DT fim", "dt-fim", "Databank")],
    ("Vencimento", [MOMENTS[0], "a combinar"], None),
    ("Vencimento", ["a combinar", "em breve"], None),
    ("dtfim", [DAYS[0], "a combinar"], None),
    ("prazo", [DAYS[0], "a combinar"], None),
    # Documents need both the header and the digits.
    ("CPF do titular", ["314.159.265-35", ELEVEN], "cpf"),
    ("CPF do titular", [ELEVEN, ELEVEN[:-1]], None),
    ("titular", [ELEVEN], None),
    ("C.N.P.J.", ["27.182.818/2845-90", FOURTEEN], "cnpj"),
    ("cpf ou cnpj", [ELEVEN], None),
    ("cpf ou cnpj", [FOURTEEN], "cnpj"),
    ("cep entrega", ["16180-339", EIGHT], "cep"),
    ("cep do contato", [EIGHT], "cep"),
    # Phones only by header, and no cell may hold an address.
    *[(name, ["(48) 3131-4242", "98765-4321"], "telefone") for name in ("Fone", "celular 2", "Contato", "WhatsApp")],
    ("Contato", ["(48) 3131-4242", "a4848@exemplo.org"], None),
    ("Contato", ["(48) 3131-4242", "ramal 12"], None),
    ("ramal", ["3131-4242"], None),
    # Blank cells say nothing.
    ("Vencimento", [None, "--", " "], None),
    ("Fone", [None, "3131-4242", "n/a"], "telefone"),
]


def test_detect_kinds_of_many_datasets_in_one_job(spark):
    rows = [
        (f"d{n}", name, text, "null" if text is None else "str", row)
        for n, (name, texts, _) in enumerate(KINDS)
        for row, text in enumerate(texts)
    ]
    cells = spark.createDataFrame(rows, "dataset string, column string, text string, tag string, _row long")
    got = {r.dataset: r.kind for r in detect_kinds(cells).collect()}
    assert got == {f"d{n}": kind for n, (_, _, kind) in enumerate(KINDS)}


TYPES = [
    ([1, 2], ["int", "int"], "BIGINT"),
    ([1, 2.5], ["int", "float"], "DOUBLE"),
    ([7, "sete"], ["int", "str"], "VARCHAR"),
    ([7, "8"], ["int", "str"], "VARCHAR"),
    (["1", "2"], ["str", "str"], "BIGINT"),
    (["1", "2.50"], ["str", "str"], "DOUBLE"),
    (["007", "42"], ["str", "str"], "VARCHAR"),
    ([None, None], ["null", "null"], "VARCHAR"),
    (["true", "false"], ["bool", "bool"], "BOOLEAN"),
    (["true", "1"], ["bool", "int"], "VARCHAR"),
    (["1", "n/a"], ["str", "str"], "VARCHAR"),
    (["2026-W36-3", "20260902"], ["str", "str"], "DATE"),
    (["20260902", "20260903"], ["str", "str"], "BIGINT"),
    (["1", None], ["str", "null"], "BIGINT"),
]


def test_infer_types(spark):
    rows = [
        (f"d{n}", "x", None if v is None else str(v), tag, i)
        for n, (values, tags, _) in enumerate(TYPES)
        for i, (v, tag) in enumerate(zip(values, tags))
    ]
    cells = spark.createDataFrame(rows, "dataset string, column string, text string, tag string, _row long")
    got = {r.dataset: r.type for r in infer_types(cells).collect()}
    assert got == {f"d{n}": t for n, (_, _, t) in enumerate(TYPES)}


def test_native_datetimes_are_timestamps(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2026-09-02 00:00:00' AS data, DATE '2026-09-02' AS dia, true AS ok")
    got = {r.column: (r.type, r.kind) for r in profile(melt(df)).collect()}
    assert got == {"data": ("TIMESTAMP", "timestamp"), "dia": ("DATE", "date"), "ok": ("BOOLEAN", None)}


def test_report_keeps_first_distinct_examples(spark):
    texts = ["02/09/2026", "x" * 50, "31/02/2025", " 31/02/2025 ", "n/a", "z", "w", None]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "_row long, data string")
    row = normalization_report(melt(df, ["data"])).collect()[0]
    assert (row.kind, row.normalized, row.nulled) == ("date", 1, 5)
    assert [row.example_1, row.example_2, row.example_3] == ["x" * 40, "31/02/2025", "z"]


def test_overflow_is_noticed(spark):
    df = spark.createDataFrame([("9223372036854775808", "9223372036854775807")], "a string, b string")
    assert {r.column: r.overflow for r in profile(melt(df)).collect()} == {"a": True, "b": False}


def test_cells_are_counted_before_they_are_shuffled(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    plan = profile(melt(df))._jdf.queryExecution().executedPlan().toString()
    # Reading upwards: the per-mask count runs before the first exchange.
    assert plan.count("Exchange") == 2
    below = plan.split("Exchange")[-1]
    assert "partial_count" in below


def test_examples_shuffle_few_rows(spark):
    """Every task sends at most three lost texts of a column, and the first three are found."""
    from tessera.operators.profile import earliest_lost, nulled_examples

    df = spark.range(8000).select(F.col("id").alias("_row"), F.when(F.col("id") % 2 == 0, F.lit("01/02/2024")).otherwise(F.concat(F.lit("x"), 9000 - F.col("id") % 3999)).alias("data"), F.lit("01/01/2024").alias("fim"))
    cells = melt(df.repartition(5), ["data", "fim"], "d").withColumn(ROW, F.struct((F.col(ROW) % 2).alias("block"), F.col(ROW).alias("id")))
    kinds = spark.createDataFrame([("d", "data", "date", 4000), ("d", "fim", "date", 0)], "dataset string, column string, kind string, nulled long")
    assert earliest_lost(cells, kinds).count() <= 3 * cells.rdd.getNumPartitions()
    got = [(r.dataset, r.column, r.rank, r.example) for r in nulled_examples(cells, kinds).orderBy("rank").collect()]
    assert got == [("d", "data", 1, "x8999"), ("d", "data", 2, "x8997"), ("d", "data", 3, "x8995")]
