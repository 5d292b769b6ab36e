"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(x: Column, y: Column) -> Column:
    """x / y, null unless y is positive."""
    return F.when(y > 0, x / y)


def ratio_nonzero(x: Column, y: Column) -> Column:
    """x / y, null where y is zero or null."""
    return F.try_divide(x, y)


def finite(c: Column) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def plain(c: Column) -> Column:
    """A double as text without an exponent from a ten-thousandth to a quadrillion; the shortest digits that tell it."""
    size = F.abs(c)
    whole, part = F.format_string("%.1f", c), F.regexp_replace(c.cast("decimal(38,21)").cast("string"), "0+$", "")
    return F.when((size >= 1e7) & (size < 1e15), F.when(c == F.floor(c), whole).otherwise(part)).when((size < 1e-3) & (size >= 1e-4), part).otherwise(c.cast("string"))


def snake(text: Column) -> Column:
    """Lower-case words joined by underscores, from any label."""
    out = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2")
    out = F.regexp_replace(F.lower(out), "[^a-z0-9]+", "_")
    return F.regexp_replace(out, "^_+|_+$", "")


def safe_label(*parts: Column) -> Column:
    """Parts joined by underscores; what is neither letter nor digit becomes one underscore; trimmed, lower case."""
    out = F.regexp_replace(F.concat_ws("_", *parts), "[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(out, "^_+|_+$", ""))


def decimal_comma(c: Column) -> Column:
    """Number from text with a decimal comma; null where it is none."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def to_decimal_comma(c: Column) -> Column:
    """Text with a decimal comma."""
    return F.replace(c.cast("string"), F.lit("."), F.lit(","))
