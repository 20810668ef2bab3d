"""Small string helpers shared by the normalizers and the scanners."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Spellings of "no value" (the em dash is not one of them).
BLANK_TOKENS = ("", "-", "--", "s/ data", "s/data", "sem data", "n/a", "na", "null", "none")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for NULL and for every spelling of a missing value; never NULL."""
    return F.coalesce(F.lower(strip(text)).isin(*BLANK_TOKENS), F.lit(True))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def at(array: Column, index: int) -> Column:
    """Element by 0-based position, NULL past the end (ANSI-safe)."""
    return F.get(array, F.lit(index))
