"""What a worksheet's formulas refer to and which of them can be derived."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.worksheet import layout, numeric_columns, stored_spread
from tessera.session import checkpointed, small

# Functions with a query-time equivalent, and the text recorded
# for a formula without one.
FUNCTIONS = "SUM|AVERAGE|STDEV|STDEV[.]S|STDEV[.]P|STDDEV|STDDEV_SAMP|STDDEV_POP"
NO_EQUIVALENT = "no equivalent query was generated"

# How a worksheet addresses cells and ranges (one to three letters, a
# row, a dollar sign before what stays in place), standing free of other words.
_EDGE = "(?<![A-Za-z0-9_])"
_END = "(?![A-Za-z0-9_])"
_ADDRESS = r"[$]?[A-Za-z]{1,3}[$]?[0-9]+"
REFERENCE = rf"{_EDGE}({_ADDRESS}(?:\s*:\s*{_ADDRESS})?){_END}"
SINGLE = r"\A[A-Za-z]{1,3}[0-9]+\z"
RANGE = r"\A[A-Za-z]{1,3}[0-9]+:[A-Za-z]{1,3}[0-9]+\z"


def column_number(letters: Column) -> Column:
    """``A`` is 1, ``Z`` is 26, ``AA`` is 27."""
    return F.aggregate(
        F.split(F.upper(letters), ""),
        F.lit(0),
        lambda total, letter: F.when(letter == "", total).otherwise(total * 26 + F.ascii(letter) - 64),
    )


def formulas(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """``[sheet, row, col, column, formula]``, one row per formula cell.

    A sheet that stores no row of its own is left out, formulas and all.
    """
    # Rows are stored exactly when some stored column has a cell.
    kept = small(numeric_columns(shape).select("sheet").distinct())
    return (
        cells.filter("is_formula and value <> ''")
        .join(small(shape.select("sheet", "col", "label", "header_row")), ["sheet", "col"])
        .filter("row > header_row")
        .join(kept, "sheet", "left_semi")
        .select("sheet", "row", "col", F.col("label").alias("column"), F.col("value").alias("formula"))
    )


def formula_inventory(cells: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """One row per distinct formula of a column."""
    shape = layout(cells) if shape is None else shape
    return formulas(cells, shape).groupBy("sheet", "col", "column", "formula").agg(F.count("*").alias("n_cells"))


def _corners(reference: Column) -> dict[str, Column]:
    plain = F.regexp_replace(reference, r"[$\s]", "")
    first, last = F.split_part(plain, F.lit(":"), F.lit(1)), F.substring_index(plain, ":", -1)
    letters = [column_number(F.regexp_extract(part, "[A-Za-z]+", 0)) for part in (first, last)]
    # Row numbers of any length stay comparable as big decimals.
    rows = [F.regexp_extract(part, "[0-9]+", 0).try_cast("decimal(38,0)") for part in (first, last)]
    return {
        "left": F.least(*letters),
        "right": F.greatest(*letters),
        "top": rows[0],
        "bottom": rows[1],
    }


def _references(text: Column) -> Column:
    """The references of a formula in order: ``array<struct<left,right,top,bottom>>``."""

    def corners(reference: Column) -> Column:
        return F.struct(*[value.alias(name) for name, value in _corners(reference).items()])

    return F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), corners)


def _with_columns(found: DataFrame, columns: DataFrame, into: str) -> DataFrame:
    """Attach what is known of a sheet's columns (``sheet, entry``) as one sorted array."""
    listed = columns.groupBy("sheet").agg(F.array_sort(F.collect_list("entry")).alias(into))
    return found.join(small(checkpointed(found.sparkSession, listed)), "sheet", "left")


def formula_inputs(cells: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """``[sheet, col, formula, input, first_use]``: headers a formula reads.

    Ranges count by column; formula columns and columns outside the sheet do
    not count. ``first_use`` orders the inputs by appearance. Every column of the
    sheet is held against the ranges, so a range costs nothing by its width.
    """
    shape = layout(cells) if shape is None else shape
    inventory = formula_inventory(cells, shape).select("sheet", "col", "formula", _references(F.col("formula")).alias("refs"))
    stored = shape.filter("not calculated").select("sheet", F.struct("col", "label").alias("entry"))
    sheets = _with_columns(inventory, stored, "stored")

    def place(refs: Column, entry: Column) -> Column:
        covers = F.transform(refs, lambda r: F.coalesce(entry["col"].between(r["left"], r["right"]), F.lit(False)))
        return F.struct(entry.alias("entry"), (F.array_position(covers, F.lit(True)) - 1).alias("ref_pos"))

    # The array of one binds the references, which are worked out once per formula.
    bound = F.transform(F.array("refs"), lambda refs: F.transform("stored", lambda entry: place(refs, entry)))
    placed = sheets.select("sheet", "col", "formula", F.explode(bound[0]).alias("x")).select("sheet", "col", "formula", "x.*").filter("ref_pos >= 0")
    # Reference and column in one number, so that inputs are combined by hashing and not sorted.
    packed = F.shiftleft("ref_pos", 32) + F.col("entry.col")
    return (
        placed.groupBy("sheet", "col", "formula", F.col("entry.label").alias("input"))
        .agg(F.min(packed).alias("_first"))
        .select(
            "sheet",
            "col",
            "formula",
            "input",
            (F.shiftright("_first", 32) * 20000 + F.col("_first").bitwiseAND(F.lit(0xFFFFFFFF))).alias("first_use"),
        )
    )


def _is_arithmetic(tokens: Column) -> Column:
    """Whether ``0`` operands, signs, operators and parentheses follow each other well.

    One fold over the characters: how deep the parentheses are, and whether an
    operand has to come next. Any nesting is judged alike.
    """
    begin = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("operand"), F.lit(True).alias("ok"))

    def step(state: Column, token: Column) -> Column:
        wanted = state["operand"]
        fits = (
            F.when(token.isin("0", "("), wanted)
            .when(token == ")", ~wanted & (state["depth"] > 0))
            .when(token.isin("*", "/"), ~wanted)
            .otherwise(token.isin("+", "-", ""))
        )
        return F.struct(
            (state["depth"] + (token == "(").cast("int") - (token == ")").cast("int")).alias("depth"),
            F.when(token.isin("0", ")"), F.lit(False)).when(token == "", wanted).otherwise(F.lit(True)).alias("operand"),
            (state["ok"] & fits).alias("ok"),
        )

    return F.aggregate(F.split(tokens, ""), begin, step, lambda end: end["ok"] & ~end["operand"] & (end["depth"] == 0))


def formula_eligibility(cells: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """``[sheet, row, col, formula, shape, verdict]`` per formula cell.

    ``shape`` is ``horizontal``, ``vertical`` or ``arithmetic``. A formula is
    derivable when all its references are relative, stay in its own row or cover
    every stored row, name each numeric stored column once, and are combined by
    a known function or by plain arithmetic.
    """
    shape = layout(cells) if shape is None else shape
    found = formulas(cells, shape)
    body = F.trim(F.expr("substr(formula, 2)"))
    call = rf"(?i)\A({FUNCTIONS})\s*[(](.*)[)]\z"
    name = F.regexp_extract(body, call, 1)
    inner = F.regexp_extract(body, call, 2)
    arguments = F.transform(F.split(inner, ",", -1), lambda part: F.trim(part))
    shaped = found.select(
        "*",
        body.alias("body"),
        (F.col("formula").startswith("=") & body.rlike(call)).alias("is_call"),
        F.when(name != "", arguments).otherwise(F.array().cast("array<string>")).alias("arguments"),
    )
    # A call takes only whole references; arithmetic is checked token by token.
    bare = F.regexp_replace("body", rf"{_EDGE}[A-Za-z]{{1,3}}[0-9]+{_END}|(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)", "0")
    signed = F.regexp_replace(bare, r"\s+", "")
    shaped = shaped.select(
        "*",
        F.forall("arguments", lambda a: a.rlike(f"{SINGLE}|{RANGE}")).alias("whole_arguments"),
        _is_arithmetic(signed).alias("plain_arithmetic"),
        F.col("body").contains("$").alias("absolute"),
        signed.contains("--").alias("doubled_sign"),
    )
    numeric = numeric_columns(shape).filter("numeric").select("sheet", F.col("col").alias("entry"))
    spread = small(checkpointed(cells.sparkSession, stored_spread(cells, shape)))
    placed = _with_columns(shaped, numeric, "numeric_cols").join(spread, "sheet", "left").withColumn("refs", _references(F.col("body")))
    refs = F.col("refs")
    flat = lambda r: r["top"] == r["bottom"]
    covered = lambda r: (r["top"] <= F.col("first_row")) & (r["bottom"] >= F.col("last_row"))
    numbers = F.coalesce("numeric_cols", F.array().cast("array<int>"))
    inside = lambda r: F.size(F.filter(numbers, lambda c: c.between(r["left"], r["right"])))
    spans = F.array_sort(F.transform(refs, lambda r: F.struct(r["left"].alias("left"), r["right"].alias("right"))))
    # Of ranges in order, two that share a column stand side by side.
    shared = F.exists(
        F.transform("spans", lambda r, i: F.coalesce(F.get("spans", i + 1)["left"] <= r["right"], F.lit(False))), lambda x: x
    )
    joined = placed.withColumn("spans", spans).select(
        "*",
        F.forall(refs, lambda r: F.when(flat(r), r["top"] == F.col("row")).otherwise(covered(r))).alias("in_place"),
        F.forall(refs, lambda r: inside(r) == r["right"] - r["left"] + 1).alias("numeric"),
        F.forall(refs, flat).alias("all_flat"),
        F.exists(refs, flat).alias("any_flat"),
        shared.alias("repeated"),
    )
    called, known = F.col("is_call"), F.coalesce(F.col("in_place"), F.lit(True))
    reason = (
        F.when(F.col("absolute"), "absolute reference")
        .when(called & ~F.col("whole_arguments"), "unsupported argument")
        .when(~called & (~F.col("plain_arithmetic") | F.col("doubled_sign")), "unsupported expression")
        .when(~known, "rows not covered")
        .when(~F.coalesce(F.col("numeric"), F.lit(True)), "input not numeric")
        .when(called & F.col("any_flat") & ~F.col("all_flat"), "mixed directions")
        .when(called & F.col("repeated"), "repeated column")
        .when(~called & ~F.coalesce(F.col("all_flat"), F.lit(True)), "unsupported expression")
    )
    direction = F.when(~called, "arithmetic").when(F.col("all_flat"), "horizontal").otherwise("vertical")
    return joined.select(
        "sheet",
        "row",
        "col",
        "formula",
        F.when(reason.isNull(), direction).alias("shape"),
        F.coalesce(reason, F.lit("derivable")).alias("verdict"),
        F.when(reason.isNotNull(), NO_EQUIVALENT).alias("note"),
    )


def column_formulas(cells: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """``[sheet, col, column, formula, inputs, verdict, n_cells, n_derivable]`` of the calculated columns.

    ``formula``, its inputs and its verdict are those of the first cell; a
    column of any length is one row.
    """
    shape = layout(cells) if shape is None else shape
    judged = formula_eligibility(cells, shape).groupBy("sheet", "col").agg(
        F.min(F.struct("row", "formula", "verdict")).alias("first"),
        F.count("*").alias("n_cells"),
        F.count_if(F.col("verdict") == "derivable").alias("n_derivable"),
    )
    firsts = judged.select("sheet", "col", "n_cells", "n_derivable", "first.formula", "first.verdict")
    used = formula_inputs(cells, shape).join(firsts.select("sheet", "col", "formula"), ["sheet", "col", "formula"])
    ordered = F.array_sort(F.collect_list(F.struct("first_use", "input")))
    used = used.groupBy("sheet", "col").agg(F.transform(ordered, lambda x: x["input"]).alias("inputs"))
    labels = shape.select("sheet", "col", F.col("label").alias("column"))
    return (
        firsts.join(labels, ["sheet", "col"])
        .join(used, ["sheet", "col"], "left")
        .select("sheet", "col", "column", "formula", F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"), "verdict", "n_cells", "n_derivable")
    )
