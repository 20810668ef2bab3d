import math

from pyspark.sql import functions as F

from tessera.functions import formula as X
from tessera.operators import formulas, worksheet
from tessera.session import small

SCHEMA = "sheet string, row int, col int, value string, value_type string, is_formula boolean"


def sheet(spark, name, *rows):
    out = []
    for r, row in enumerate(rows, 1):
        for c, value in enumerate(row, 1):
            if value is None:
                continue
            kind = "bool" if isinstance(value, bool) else type(value).__name__
            out.append((name, r, c, str(value), kind, isinstance(value, str) and value.startswith("=")))
    return out


def test_worksheets(spark):
    rows = sheet(spark, "Results", ["A", "B", "Total"], [None, None, "=SUM(A2:B2)"], [2, 3, "=SUM(A3:B3)"])
    rows += sheet(spark, "Other", ["Code", "Name"], ["0012", "Ana"])
    rows += sheet(spark, "Formula Only", ["Value", "Total"], [None, "=SUM(A2:A2)"])
    rows += sheet(spark, "Header", ["x", "y"])
    cells = spark.createDataFrame(rows, SCHEMA)
    shape = worksheet.layout(cells)
    got = [(r.dataset, r["_row"], r.column, r.text, r.tag) for r in worksheet.to_cells(cells, shape).orderBy("dataset", "_row", "pos").collect()]
    assert got == [
        ("Other", 2, "Code", "0012", "str"), ("Other", 2, "Name", "Ana", "str"),
        ("Results", 3, "A", "2", "int"), ("Results", 3, "B", "3", "int"),
    ]
    dropped = {(r.sheet, r.row) for r in worksheet.dropped_rows(cells, shape).collect()}
    assert dropped == {("Results", 2), ("Formula Only", 2)}
    inputs = formulas.formula_inputs(cells, shape).filter("formula = '=SUM(A2:B2)'").orderBy("first_use").collect()
    assert [r.input for r in inputs] == ["A", "B"]
    assert {r.sheet for r in formulas.formula_inventory(cells, shape).collect()} == {"Results"}
    assert worksheet.to_table(cells, "Results").drop("_row").collect() == [("2", "3")]


def test_duplicate_labels(spark):
    cells = spark.createDataFrame(sheet(spark, "S", ["a", None, None, "b"], [1, 2, 3, 4]), SCHEMA)
    got = worksheet.duplicate_labels(worksheet.layout(cells)).collect()
    assert [(r.label, r.first_pos, r.last_pos) for r in got] == [("", 2, 3)]


ELIGIBLE = {
    "=SUM(A2:B2)": "horizontal", "=average( A2 , B2 )": "horizontal", "=STDEV.P(A2:B2)": "horizontal",
    "=SUM(A2:A9)": "vertical", "=SUM(A2:A9,B2:B9)": "vertical", "=A2*(B2+2)/-A2": "arithmetic",
    "=(A2+(B2-1))*2.5": "arithmetic", "=((A2))": "arithmetic", "=1+1": "arithmetic",
    "=SUM($A2:B2)": None, "=$A2+1": None, "=SUM(A3:B3)": None, "=A3+1": None, "=SUM(A2:A2,B1:B9)": None,
    "=SUM(A2,A2)": None, "=SUM(A3:A9)": None, "=SUM(A2:C2)": None, "=SUM(A2:D2)": None, "=MAX(A2:B2)": None,
    "=A2--1": None, "=A2:B2": None, "=SUM()": None, "=SUM(A2,)": None, "=SUM(1,A2)": None, "=A2+": None, "=(A2": None,
    "=C2+1": None, "=IF(A2>1,1,2)": None,
}


def test_eligibility(spark):
    rows = []
    for n, text in enumerate(ELIGIBLE):
        rows += sheet(spark, f"s{n}", ["a", "b", "c", "t"], [1, 2, "x", text], [3, 4, "y", None])
    got = formulas.formula_eligibility(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.formula: r.shape for r in got} == ELIGIBLE
    assert all((r.note is None) == (r.verdict == "derivable") for r in got)


def test_any_nesting_and_any_length_is_judged(spark):
    deep, long = "=" + "(" * 50 + "A2" + ")" * 50 + "*2", "=A2" + "+B2*1" * 250_000
    texts = {deep: "arithmetic", deep + ")": None, long: "arithmetic", long + "+": None, "=()": None, "=A2(B2)": None}
    rows = []
    for n, text in enumerate(texts):
        rows += sheet(spark, f"s{n}", ["a", "b", "t"], [1, 2, text], [3, 4, None])
    got = formulas.formula_eligibility(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.formula: r.shape for r in got} == texts


def test_column_numbers(spark):
    letters = {"A": 1, "Z": 26, "aa": 27, "XFD": 16384, "ZZZ": 18278}
    df = spark.createDataFrame([(k,) for k in letters], "l string")
    assert {r.l: r.n for r in df.select("l", formulas.column_number(F.col("l")).alias("n")).collect()} == letters


def test_row_formulas(spark):
    df = spark.createDataFrame([("1", "x", "3"), (None, None, None), ("2", None, None)], "a string, b string, c string")
    cells = [F.col(c) for c in "abc"]
    rows = df.select(
        X.row_sum(*cells).alias("s"), X.row_average(*cells).alias("m"), X.row_stddev(*cells).alias("d"),
        X.row_stddev(*cells, pop=True).alias("p"), X.divide(X.operand(cells[0]), X.operand(cells[1])).alias("q"),
    ).collect()
    assert tuple(rows[0]) == (4.0, 2.0, math.sqrt(2), 1.0, None)
    assert tuple(rows[1]) == (0.0, None, None, None, None)
    assert tuple(rows[2]) == (2.0, 2.0, None, 0.0, None)


def test_column_and_block_formulas(spark):
    df = spark.createDataFrame([("1", "10"), ("x", "20"), ("3", None)], "a string, b string")
    a, b = F.col("a"), F.col("b")
    row = df.agg(X.column_sum(a), X.column_average(a), X.column_stddev(a), X.block_sum(a, b), X.block_average(a, b)).first()
    assert tuple(row) == (4.0, 2.0, math.sqrt(2), 34.0, 8.5)
    spread = X.block_stddev(df, ["a", "b"]).first().stddev
    assert math.isclose(spread, math.sqrt(sum((v - 8.5) ** 2 for v in (1, 3, 10, 20)) / 3))
    empty = df.filter("false").agg(X.column_sum(a), X.column_average(a)).first()
    assert tuple(empty) == (0.0, None)


def test_ranges_cost_nothing_by_their_width(spark):
    rows = sheet(spark, "S", ["a", "b", "t"], [1, 2, "=SUM(A2:ZZZ2)"], [3, 4, "=SUM(A3:B3)"])
    cells = spark.createDataFrame(rows, SCHEMA)
    inputs = formulas.formula_inputs(cells)
    assert sorted((r.formula, r.input) for r in inputs.collect()) == [(f, i) for f in ("=SUM(A2:ZZZ2)", "=SUM(A3:B3)") for i in "ab"]
    judged = formulas.formula_eligibility(cells)
    assert {r.formula: r.shape for r in judged.collect()} == {"=SUM(A2:ZZZ2)": None, "=SUM(A3:B3)": "horizontal"}
    assert "sequence" not in judged._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_sheets_are_shuffled_once(spark):
    cells = spark.createDataFrame(sheet(spark, "S", ["a", "b"], [1, 2], [3, 4]), SCHEMA)
    shape = worksheet.layout(cells)
    plan = worksheet.to_cells(cells, shape)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_broadcast_counts_bytes(spark):
    few = spark.createDataFrame([("x" * 1000,)] * 50, "a string")
    hinted = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small(few)) and not hinted(small(few, rows=49)) and not hinted(small(few, size=10_000))


def test_formula_values(spark):
    import math
    import statistics

    from tessera.operators.formula_values import formula_values

    a, b = [4.0, None, 10.0, -3.5], [1.0, 2.0, 0.0, 5.0]
    texts = {
        "=A{r}+B{r}*2": lambda x, y: x + y * 2,
        "=(A{r}-B{r})/B{r}": lambda x, y: (x - y) / y if y else None,
        "=-(A{r}+1)*-B{r}": lambda x, y: -(x + 1) * -y,
        "= 2 * ( 3 - A{r} / ( 1 + 1 ) ) - .5": lambda x, y: 2 * (3 - x / 2) - 0.5,
        "=A{r}-B{r}-1": lambda x, y: x - y - 1,
        "=A{r}/B{r}/2": lambda x, y: x / y / 2 if y else None,
    }
    rows, want = [], {}
    for n, (text, value) in enumerate(texts.items()):
        sheet = f"s{n}"
        rows += [(sheet, 1, k, label, "str", False) for k, label in enumerate(("A", "B", "C", "D", "E", "F"), 1)]
        for i, (x, y) in enumerate(zip(a, b)):
            r = i + 2
            rows += [(sheet, r, 1, None if x is None else str(x), "float", False), (sheet, r, 2, str(y), "float", False)]
            calls = {3: text.format(r=r), 4: f"=STDEV(A{r}:B{r})", 5: "=AVERAGE(A2:B5)", 6: "=STDDEV_POP(A2:A5)"}
            rows += [(sheet, r, c, t, "str", True) for c, t in calls.items()]
            row = [v for v in (x, y) if v is not None]
            whole, first = [v for v in a + b if v is not None], [v for v in a if v is not None]
            want |= {
                (sheet, r, 3): value(x or 0.0, y), (sheet, r, 4): statistics.stdev(row) if len(row) > 1 else None,
                (sheet, r, 5): statistics.mean(whole), (sheet, r, 6): statistics.pstdev(first),
            }
    rows += [("none", 1, 1, "A", "str", False), ("none", 1, 2, "B", "str", False), ("none", 2, 1, "x", "str", False), ("none", 2, 2, "=A2+1", "str", True)]
    cells = spark.createDataFrame(rows, "sheet string, row long, col int, value string, value_type string, is_formula boolean")
    got = {(r.sheet, r.row, r.col): r.value for r in formula_values(cells).collect()}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert (got[key] is None) == (value is None) and (value is None or math.isclose(got[key], value, abs_tol=1e-9)), key
