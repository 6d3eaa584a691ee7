"""Small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Null for empty text.

    ``nullif`` would evaluate its argument twice, a regex pass in most uses here, and nested uses
    would double again. Dropping it from a one-element array refers to it once.
    """
    return F.get(F.array_remove(F.array(c), ""), F.lit(0))


def first_filled(*choices: Column) -> Column:
    """The first choice that is neither null nor empty; the last one stands whatever it is."""
    *tried, last = choices
    return F.coalesce(*[blank_to_null(c) for c in tried], last)


def safe_int(c: Column) -> Column:
    return c.try_cast("int")


def capture(text: Column, pattern: str, needs: str | None = None, group: int = 1) -> Column:
    """A capture group, or null on a miss.

    ``needs`` is a literal every match contains: a plain substring test is far cheaper than a
    regex pass, so rows without it skip the regex.
    """
    found = blank_to_null(F.regexp_extract(text, pattern, group))
    return F.when(text.contains(needs), found) if needs else found


def escape_quotes(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit('\\"'))


def clip_text(c: Column, length: int) -> Column:
    return F.substring(c, 1, length)


def pad_left(c: Column, width: int) -> Column:
    """Right-align without ever cutting longer text."""
    return F.when(F.char_length(c) < width, F.lpad(c, width, " ")).otherwise(c)


def pad_right(c: Column, width: int) -> Column:
    return F.when(F.char_length(c) < width, F.rpad(c, width, " ")).otherwise(c)


def shown(c: Column) -> Column:
    """Text as a report prints it: a missing value reads ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))
