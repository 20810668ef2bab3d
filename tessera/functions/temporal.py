"""Date and timestamp parsing for Brazilian and ISO spellings.

A text is matched once: one regular expression covers all spellings, and its
replacement writes the fields in a fixed order (year, month, day, hour, minute,
second, fraction, offset), so the expression decides which group is the year
and nothing downstream branches. A text that does not match has no separators,
splits into a single piece, and every later field is NULL.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import WHITESPACE, at, strip

# Portuguese months; three letters decide.
MONTHS = (
    "janeiro", "fevereiro", "março", "abril", "maio", "junho",
    "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
)

SEPARATOR = "\u0001"
FIELDS = ("year", "month", "day", "marker", "hour", "minute", "second", "fraction", "offset")

_LETTERS = "(?iu:[a-zç]{%s})"
# Year first. Two dashes allow a one-digit day, other separators do not.
_YEAR_FIRST = (
    "([0-9]{4})(?:-(?=[0-9]{1,2}-)|[/.-](?=[0-9]{1,2}[/.-][0-9]{2}))([0-9]{1,2})[/.-]([0-9]{1,4})"
)
# Day first, the month as a number or a name; a named month takes no third digit.
_DAY_FIRST = (
    "(?![0-9]{3}[/.-][^0-9])([0-9]{1,3})[/.-]([0-9]{1,2}|%s)[/.-]([0-9]{2,4})" % (_LETTERS % "3,9")
)
_WRITTEN = (
    "([0-9]{1,2})(?iuU:\\s+de\\s+)(%s)[.]?(?iuU:\\s+de\\s+)?([0-9]{4})" % (_LETTERS % "1,")
)
# Seconds stop at 59: the timestamp constructor would roll 60 over.
_CLOCK = (
    "(?:([Tt ])([0-9]{1,2}):([0-9]{2})(?::([0-5][0-9])(?:[.]([0-9]{1,6}))?)?"
    "(?U:\\s*)(Z|[+-][0-9]{2}:?[0-9]{2})?)?"
)
PATTERN = f"^(?:(?:{_YEAR_FIRST}|{_DAY_FIRST}){_CLOCK}|{_WRITTEN})\\n?\\z"
# A group that took no part in the match adds nothing, so the groups of one
# field are simply written next to each other.
REPLACEMENT = SEPARATOR.join(
    ("$1$6$15", "$2$5$14", "$3$4$13", "$7", "$8", "$9", "$10", "$11", "$12")
)


def _pieces(text: Column) -> Column:
    trimmed = F.rtrim(strip(text), F.lit("."))
    # A cell that already holds the separator cannot be a date.
    safe = F.translate(trimmed, SEPARATOR, "\ufffd")
    written = F.regexp_replace(safe, F.lit(PATTERN), F.lit(REPLACEMENT))
    # Every date starts with a digit and has two separators, which plain numbers have not;
    # other cells never reach the expression.
    dated = F.ascii(F.ltrim(text, F.lit(WHITESPACE))).between(48, 57) & text.rlike("(?s)[^0-9].*[^0-9]")
    return F.when(dated, F.split(written, SEPARATOR))


def _field(pieces: Column, name: str) -> Column:
    return at(pieces, FIELDS.index(name))


def _month_number(token: Column) -> Column:
    names = F.create_map(
        *[F.lit(part) for n, name in enumerate(MONTHS, 1) for part in (name.replace("ç", "c")[:3], n)]
    )
    prefix = F.substring(F.translate(F.lower(token), "ç", "c"), 1, 3)
    return F.coalesce(token.try_cast("int"), F.try_element_at(names, prefix))


def _offset_minutes(offset: Column) -> Column:
    """Minutes east of UTC, 0 for none or Z, NULL when 24 hours or more."""
    plain = F.translate(offset, ":Z", "")
    size = F.substring(plain, 2, 2).try_cast("int") * 60 + F.substring(plain, 4, 2).try_cast("int")
    signed = F.when(plain.startswith("-"), -size).otherwise(size)
    return F.when(plain == "", F.lit(0)).when(size < 1440, signed)


def _local(pieces: Column) -> Column:
    """The moment as written, before its offset; NULL for an impossible date."""
    month = _field(pieces, "month")
    # Only after a named month may the clock start with a small t.
    sound = (_field(pieces, "marker") != "t") | ~F.ascii(month).between(48, 57)
    year = F.when(sound, _field(pieces, "year")).try_cast("int")
    seconds = F.concat(
        F.lit("0"), _field(pieces, "second"), F.lit("."), _field(pieces, "fraction"), F.lit("0")
    )
    return F.try_make_timestamp_ntz(
        F.when(year < 100, year + 2000).otherwise(year),
        _month_number(month),
        _field(pieces, "day").try_cast("int"),
        F.concat(F.lit("0"), _field(pieces, "hour")).try_cast("int"),
        F.concat(F.lit("0"), _field(pieces, "minute")).try_cast("int"),
        seconds.try_cast("decimal(16,6)"),
    )


def _shifted(pieces: Column) -> Column:
    minutes = _offset_minutes(_field(pieces, "offset"))
    return _local(pieces) - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def _outcome(moment: Column, pieces: Column) -> Column:
    in_range = F.year(moment).between(1, 9999)
    return F.struct(
        F.when(in_range, moment).alias("ts"),
        F.when(in_range, _field(pieces, "hour") != "").alias("has_time"),
    )


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times."""
    return at(F.transform(F.array(value), body), 0)


def parse_temporal(text: Column) -> Column:
    """``struct(ts timestamp_ntz, has_time boolean)``, fields NULL when unparseable.

    Day comes first unless the first group has four digits, years below 100
    belong to the 2000s, offsets are converted to UTC and dropped. This form
    fits into any expression; jobs over whole tables use :func:`with_moments`,
    which gives the same values through generated code.
    """
    return _let(_pieces(text), lambda pieces: _let(_shifted(pieces), lambda m: _outcome(m, pieces)))


def with_moments(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Add one parsed struct per entry of ``texts``.

    The steps are separate projections: the optimizer keeps a costly column
    that is used several times instead of repeating its expression, so every
    text meets the regular expression once and the code stays small.
    """
    pieces = {name: f"_pieces_{name}" for name in texts}
    moments = {name: f"_moment_{name}" for name in texts}
    staged = df.withColumns({pieces[name]: _pieces(text) for name, text in texts.items()})
    staged = staged.withColumns({moments[n]: _shifted(F.col(f"`{pieces[n]}`")) for n in texts})
    staged = staged.withColumns(
        {n: _outcome(F.col(f"`{moments[n]}`"), F.col(f"`{pieces[n]}`")) for n in texts}
    )
    return staged.drop(*pieces.values(), *moments.values())


def parse_timestamp(text: Column) -> Column:
    return parse_temporal(text)["ts"]


def parse_date(text: Column) -> Column:
    return parse_temporal(text)["ts"].cast("date")


def iso_calendar_date(text: Column) -> Column:
    """Strict ISO 8601 calendar or week date, extended or basic; else NULL."""
    compact = F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.translate(text, "-", ""))
    compact = compact.when(text.rlike(r"\A[0-9]{8}\z"), text)
    day = F.try_make_timestamp_ntz(
        F.substring(compact, 1, 4).try_cast("int"),
        F.substring(compact, 5, 2).try_cast("int"),
        F.substring(compact, 7, 2).try_cast("int"),
        F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"),
    ).cast("date")

    is_week = text.rlike(r"\A[0-9]{4}(?:-W[0-9]{2}(?:-[1-7])?|W[0-9]{2}[1-7]?)\z")
    week_text = F.when(is_week, F.translate(text, "-W", ""))
    year = F.substring(week_text, 1, 4).try_cast("int")
    week = F.substring(week_text, 5, 2).try_cast("int")
    weekday = F.coalesce(F.substring(week_text, 7, 1).try_cast("int"), F.lit(1))
    # January 4th is always in week 1; step back to that week's Monday.
    fourth = F.try_make_timestamp_ntz(
        year, F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")
    ).cast("date")
    monday = F.date_sub(fourth, F.weekday(fourth))
    week_day = F.date_add(monday, (week - 1) * 7 + weekday - 1)
    last_week = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    in_year = week.between(1, last_week) & (year >= 1) & F.year(week_day).between(1, 9999)
    return F.coalesce(day, F.when(in_year, week_day))
