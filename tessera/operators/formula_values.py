"""Values of derivable formulas, for any number of sheets in one job.

Formulas that say the same of their own row (``=A5*(B5+2)`` in row 5, ``=A6*(B6+2)``
in row 6) are one text once the rows are taken out. Each such text is compiled
once, to codes in postfix order; cells take the codes of their text and are
evaluated side by side, each over the numbers of its own row, which travel as one
map per row. Formulas over whole columns read counts, means and squared deviations
that are worked out once per column of a sheet and combined exactly.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.formulas import _references, column_number, formula_eligibility
from tessera.operators.worksheet import layout, numeric_columns, stored_cells
from tessera.session import checkpointed

# Which functions are a sample's and which a population's deviation.
SAMPLE, POPULATION = ("STDEV", "STDEV.S", "STDDEV", "STDDEV_SAMP"), ("STDEV.P", "STDDEV_POP")

CODES, STACK = "array<string>", "array<double>"
TOKEN = r"([A-Za-z]{1,3}[0-9]+|[0-9]+(?:[.][0-9]*)?|[.][0-9]+|[-+*/()])"


def _strength(code: Column) -> Column:
    """How strongly an operator binds; a parenthesis holds everything back."""
    return F.when(code == "neg", 3).when(code.isin("*", "/"), 2).when(code.isin("+", "-"), 1).otherwise(0)


def compiled(text: Column) -> Column:
    """Plain arithmetic as codes in postfix order: ``c2`` (column 2), a number, an operator or ``neg``."""
    begin = F.struct(F.array().cast(CODES).alias("out"), F.array().cast(CODES).alias("open"), F.lit(True).alias("first"))

    def moved(state: Column, keep: Column) -> tuple[Column, Column]:
        """Operators above the first ``keep`` go out, the last one first."""
        held = state["open"]
        return F.concat(state["out"], F.reverse(F.slice(held, keep + 1, F.size(held)))), F.slice(held, F.lit(1), keep)

    def step(state: Column, token: Column) -> Column:
        held = state["open"]
        last = lambda rule: F.coalesce(F.array_max(F.transform(held, lambda o, i: F.when(rule(o), i + 1).otherwise(0))), F.lit(0))
        reference = F.concat(F.lit("c"), column_number(F.regexp_extract(token, "[A-Za-z]+", 0)).cast("string"))
        operand = F.when(token.rlike("^[A-Za-z]"), reference).otherwise(token)
        closed_out, closed = moved(state, last(lambda o: o == "("))
        passed_out, passed = moved(state, last(lambda o: (o == "(") | (_strength(o) < _strength(token))))
        case = lambda out, open_, first: F.struct(out.alias("out"), open_.alias("open"), F.lit(first).alias("first"))
        return (
            F.when(token == "(", case(state["out"], F.concat(held, F.array(F.lit("("))), True))
            .when(token == ")", case(closed_out, F.slice(closed, F.lit(1), F.greatest(F.size(closed) - 1, F.lit(0))), False))
            .when(state["first"] & (token == "-"), case(state["out"], F.concat(held, F.array(F.lit("neg"))), True))
            .when(state["first"] & (token == "+"), case(state["out"], held, True))
            .when(token.isin("+", "-", "*", "/"), case(passed_out, F.concat(passed, F.array(token)), True))
            .otherwise(case(F.concat(state["out"], F.array(operand)), held, False))
        )

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))
    return F.aggregate(tokens, begin, step, lambda end: moved(end, F.lit(0))[0])


def evaluated(codes: Column, values: Column) -> Column:
    """The value of compiled codes over a map of column numbers to numbers; what is missing counts as 0."""

    def step(stack: Column, code: Column) -> Column:
        size = F.size(stack)
        right, left = F.get(stack, size - 1), F.get(stack, size - 2)
        number = F.when(code.startswith("c"), F.coalesce(F.try_element_at(values, F.substring(code, 2, 9).try_cast("int")), F.lit(0.0))).otherwise(code.try_cast("double"))
        push = lambda keep, value: F.concat(F.slice(stack, F.lit(1), keep), F.array(value)).cast(STACK)
        quotient = left / F.nullif(right, F.lit(0.0))
        result = F.when(code == "+", left + right).when(code == "-", left - right).when(code == "*", left * right).otherwise(quotient)
        return F.when(code.isin("+", "-", "*", "/"), push(size - 2, result)).when(code == "neg", push(size - 1, -right)).otherwise(push(size, number))

    return F.get(F.aggregate(codes, F.array().cast(STACK), step), F.lit(0))


def _called(name: Column, n: Column, mean: Column, squares: Column) -> Column:
    """A function's value from the count, the mean and the summed squared deviations of its numbers."""
    return (
        F.when(name == "SUM", F.coalesce(n * mean, F.lit(0.0)))
        .when(name == "AVERAGE", mean)
        .when(name.isin(*SAMPLE), F.sqrt(squares / F.nullif(F.greatest(n - 1, F.lit(0)), F.lit(0))))
        .when(name.isin(*POPULATION), F.sqrt(squares / F.nullif(n, F.lit(0))))
    )


def _columns_of(refs: Column) -> Column:
    return F.flatten(F.transform(refs, lambda r: F.sequence(r["left"], r["right"])))


def formula_values(cells: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """``[sheet, row, col, formula, shape, value]`` of every derivable formula cell."""
    shape = layout(cells) if shape is None else shape
    judged = formula_eligibility(cells, shape).filter("verdict = 'derivable'").select("sheet", "row", "col", "formula", "shape")
    # The text without its rows, by which equal formulas are known.
    body = F.trim(F.expr("substr(formula, 2)"))
    template = F.when(F.col("shape") == "arithmetic", F.regexp_replace(body, r"(?<![A-Za-z0-9_])([A-Za-z]{1,3})[0-9]+(?![A-Za-z0-9_])", "$11"))
    judged = checkpointed(cells.sparkSession, judged.withColumns({"name": F.upper(F.regexp_extract(body, r"\A([A-Za-z_.]+)\s*[(]", 1)), "refs": _references(body), "template": template}))
    codes = judged.filter("template IS NOT NULL").select("template").distinct().withColumn("codes", compiled(F.col("template")))
    numbers = numeric_columns(shape).filter("numeric").select("sheet", "col")
    values = stored_cells(cells, shape).join(numbers, ["sheet", "col"], "left_semi").select("sheet", "row", "col", F.col("value").try_cast("double").alias("x")).filter("x IS NOT NULL")
    by_row = values.groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "x"))).alias("of"))
    nothing = F.create_map().cast("map<int,double>")
    flat = judged.filter("shape <> 'vertical'").join(codes, "template", "left").join(by_row, ["sheet", "row"], "left").withColumn("of", F.coalesce("of", nothing))
    held = F.filter(F.transform(_columns_of(F.col("refs")), lambda c: F.try_element_at("of", c)), lambda x: x.isNotNull())
    flat = flat.withColumn("held", F.when(F.col("template").isNull(), held))
    n = F.size("held").cast("double")
    flat = flat.withColumns({"n": n, "mean": F.aggregate("held", F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0.0))})
    squares = F.aggregate("held", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("mean"), F.lit(2)))
    horizontal = _called(F.col("name"), F.col("n"), F.col("mean"), squares)
    across = flat.withColumn("value", F.when(F.col("template").isNotNull(), evaluated(F.col("codes"), F.col("of"))).otherwise(horizontal))
    part = F.struct("col", F.struct("n", "mean", "squares"))
    stats = values.groupBy("sheet", "col").agg(F.count("x").cast("double").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("squares"))
    stats = stats.groupBy("sheet").agg(F.map_from_entries(F.collect_list(part)).alias("of"))
    down = judged.filter("shape = 'vertical'").select("sheet", "formula", "name", "refs").dropDuplicates(["sheet", "formula"]).join(stats, "sheet", "left")
    parts = F.filter(F.transform(_columns_of(F.col("refs")), lambda c: F.try_element_at("of", c)), lambda x: x.isNotNull())
    down = down.withColumn("parts", F.coalesce(parts, F.array().cast("array<struct<n:double,mean:double,squares:double>>")))
    down = down.withColumn("n", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"]))
    down = down.withColumn("mean", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * p["mean"]) / F.nullif("n", F.lit(0.0)))
    spread = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["squares"] + p["n"] * F.pow(p["mean"] - F.col("mean"), F.lit(2)))
    down = down.select("sheet", "formula", _called(F.col("name"), F.col("n"), F.col("mean"), spread).alias("value"))
    vertical = judged.filter("shape = 'vertical'").join(down, ["sheet", "formula"])
    columns = ["sheet", "row", "col", "formula", "shape", "value"]
    return across.select(columns).unionByName(vertical.select(columns))
