"""Which type holds the number a text spells, without losing any of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits alone, with a point, and with an exponent; blanks around them do not count.
WHOLE = r"^\s*[+-]?\d+\s*$"
PLAIN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"
FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Numbers of so many digits come back from a double that is not close to zero.
SAFE_DIGITS, SMALLEST = 15, 2.3e-308
MOST_DIGITS = 38


def significant(c: Column) -> Column:
    """The digits of a number without its sign, point, exponent and outer zeros."""
    return F.trim(F.regexp_replace(c, r"[eE].*$|[^0-9]", ""), F.lit("0"))


def is_whole(c: Column, exact_text: bool = False) -> Column:
    """Does bigint hold the number, or with ``exact_text`` the text itself?"""
    number = F.when(c.rlike(WHOLE), c.try_cast("bigint"))
    return F.coalesce(number.cast("string") == c, F.lit(False)) if exact_text else number.isNotNull()


def is_double(c: Column, exact_text: bool = False) -> Column:
    """Does a double, written out again, give the number (or the text)?

    Numbers of up to 15 digits do; of longer ones the digits are compared.
    """
    number = F.when(c.rlike(FLOAT), c.try_cast("double"))
    if exact_text:
        return F.coalesce(number.cast("string") == c, F.lit(False))
    digits, size = significant(c), F.abs(number)
    short = (F.length(digits) <= SAFE_DIGITS) & (size >= SMALLEST) & (size < float("inf"))
    return F.coalesce((digits == "") | short | (significant(number.cast("string")) == digits), F.lit(False)) & number.isNotNull()


def whole_digits(c: Column) -> Column:
    """Digits before the point of a plain number, without zeros ahead; null for other text."""
    return F.when(c.rlike(PLAIN), F.length(F.ltrim(F.regexp_replace(c, r"\..*$|[^0-9]", ""), F.lit("0"))))


def point_digits(c: Column, exact_text: bool = False) -> Column:
    """Digits after the point of a plain number, without zeros at the end unless ``exact_text``."""
    after = F.regexp_extract(c, r"\.(\d*)", 1)
    return F.when(c.rlike(PLAIN), F.length(after if exact_text else F.rtrim(after, F.lit("0"))))


def is_decimal(c: Column, precision: int, scale: int) -> Column:
    """Does ``decimal(precision, scale)`` hold the number?"""
    return F.coalesce((whole_digits(c) <= precision - scale) & (point_digits(c) <= scale), F.lit(False))


def is_written_decimal(c: Column) -> Column:
    """Is the text spelled as a decimal of the right scale would be?"""
    return c.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?$") & ~c.rlike(r"^-0(\.0+)?$")
