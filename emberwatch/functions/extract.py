"""Timestamp, address and user extraction from free log text."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.functions.text import capture

# Character classes. Digits are ASCII; words and spaces follow Unicode, which the engine's
# own shorthand classes do not.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
INK = r"[^\t-\r\x1c-\x1f\x85\p{Z}]"

# Address shape, time shapes and user shapes, each list in order of trial.
# The digit look-ahead comes first: it fails fast on most characters.
ADDRESS = rf"(?=\d)(?<!{WORD})(\d{{1,3}}(?:\.\d{{1,3}}){{3}})(?!{WORD})"

ISO_TIME = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})"
KEYED_TIME = rf"date=(\d{{4}}-\d{{2}}-\d{{2}}){SPACE}+time=(\d{{2}}:\d{{2}}:\d{{2}})"
SYSLOG_TIME = rf"([A-Z][a-z]{{2}}{SPACE}+\d{{1,2}}{SPACE}+\d{{2}}:\d{{2}}:\d{{2}})"
BRACKET_TIME = (
    rf"\[(?:{WORD}{{3}}{SPACE}+)?"
    rf"({WORD}{{3}}{SPACE}+\d{{1,2}}{SPACE}+\d{{2}}:\d{{2}}:\d{{2}}{SPACE}+\d{{4}})\]"
)
DOTTED_TIME = rf"\[Time{SPACE}+(\d{{4}}\.\d{{2}}\.\d{{2}}{SPACE}+\d{{2}}:\d{{2}}:\d{{2}})"
CLOCK_TIME = rf"^(\d{{2}}:\d{{2}}:\d{{2}}){SPACE}"
PLAIN_TIME = rf"(\d{{4}}-\d{{2}}-\d{{2}}{SPACE}+\d{{2}}:\d{{2}}:\d{{2}})"
AT_TIME = rf"At{SPACE}+(\d{{2}}:\d{{2}}:\d{{2}}){SPACE}+(\d{{2}}/\d{{2}}/\d{{4}})"
ACCESS_TIME = rf"\[(\d{{2}}/{WORD}{{3}}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}})"

USER_SHAPES = [
    (rf"account=({INK}+)", "account="),
    (rf"for user ({INK}+)", "for user "),
    (rf"session (?:opened|closed) for user ({INK}+)", "for user "),
    (rf"for ({WORD}+){SPACE}+from{SPACE}+\d", "for "),
    (rf"\] user ({WORD}+):", "] user "),
    (rf"user ({WORD}+)", "user "),
    (r"\(([^)][^)@]*@[^)]+)\)", "@"),
    (rf"by \(uid=\d+\)[^\n]*?user ({INK}+)", "by (uid="),
]

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# A time read without a year, or with this one, takes the current year.
UNSET_YEAR = "1900"


class Clock(NamedTuple):
    """The moment a row without a usable time falls back to."""

    text: Column
    year: Column


def clock(as_of: str | datetime | None = None) -> Clock:
    """A fixed moment for repeatable runs, or the query's own start time in UTC."""
    if as_of is None:
        now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
        text = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
        return Clock(text, F.date_format(now, "yyyy"))
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    as_of = as_of.astimezone(timezone.utc)
    return Clock(F.lit(as_of.isoformat()), F.lit(f"{as_of.year:04d}"))


def _checked(date_time: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` if it is a real moment from year 1 on, else null.

    Casting to the zone-less type and back validates and zero-pads in one pass, and no session
    time zone can shift the value. Only a year is followed by a dash after four digits.
    """
    no_year_zero = F.replace(date_time, F.lit("0000-"), F.lit("-"))
    return no_year_zero.try_cast("timestamp_ntz").cast("string")


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def _month_numbers(c: Column) -> Column:
    """Month names to two digits; the shapes hold no other letters in their captures."""
    c = F.lower(c)
    for number, name in enumerate(MONTHS, start=1):
        c = F.replace(c, F.lit(name), F.lit(f"{number:02d}"))
    return c


def parse_timestamp(log: Column, at: Clock) -> Column:
    """ISO text of the first time shape that matches and is a real date, else ``at``.

    Only the first occurrence of each shape is tried. Every capture is rewritten to ISO order by
    a chain that refers to it once, so a log is scanned once per shape tried. A miss is empty
    text, which no rewrite changes and the check turns into null.
    """

    def piece(shape: str, needs: str, group: int = 1) -> Column:
        return F.when(log.contains(needs), F.regexp_extract(log, shape, group))

    def in_year(c: Column) -> Column:
        return F.replace(c, F.lit(f"{UNSET_YEAR}-"), F.concat(at.year, F.lit("-")))

    iso = F.replace(piece(ISO_TIME, "T"), F.lit("T"), F.lit(" "))
    keyed = _squeezed(piece(KEYED_TIME, "date=", 0))
    syslog = _month_numbers(_squeezed(piece(SYSLOG_TIME, ":")))
    bracket = _month_numbers(_squeezed(piece(BRACKET_TIME, "[")))
    dotted = _squeezed(piece(DOTTED_TIME, "[Time"))
    at_time = _squeezed(piece(AT_TIME, "At", 0))
    access = _month_numbers(piece(ACCESS_TIME, "["))
    found = F.coalesce(
        in_year(_checked(iso)),
        _checked(F.regexp_replace(keyed, "^date=(.{10}) time=", "$1 ")),
        in_year(_checked(F.regexp_replace(
            syslog, r"^(\d\d) (\d\d?) (.{8})$", f"{UNSET_YEAR}-$1-$2 $3"))),
        in_year(_checked(F.regexp_replace(
            bracket, r"^(\d\d) (\d\d?) (.{8}) (.{4})$", "$4-$1-$2 $3"))),
        in_year(_checked(F.translate(dotted, ".", "-"))),
        in_year(_checked(F.regexp_replace(
            piece(CLOCK_TIME, ":"), "^(.{8})$", f"{UNSET_YEAR}-01-01 $1"))),
        in_year(_checked(_squeezed(piece(PLAIN_TIME, ":")))),
        _checked(F.regexp_replace(at_time, "^At (.{8}) (..)/(..)/(.{4})$", "$4-$3-$2 $1")),
        in_year(_checked(F.regexp_replace(
            access, r"^(\d\d)/(\d\d)/(.{4}):(.{8})$", "$3-$2-$1 $4"))),
    )
    return F.coalesce(F.concat(F.replace(found, F.lit(" "), F.lit("T")), F.lit("+00:00")), at.text)


def parse_instant(text: Column) -> Column:
    """ISO text, with any offset spelling, to an instant; null if unreadable."""
    return text.try_cast("timestamp")


def addresses(log: Column) -> Column:
    """Every dotted quad in reading order; octets are not range-checked."""
    return F.regexp_extract_all(log, F.lit(ADDRESS), 1)


def nth_address(found: Column, n: int) -> Column:
    return F.get(found, F.lit(n))


def parse_user(log: Column) -> Column:
    """The first user shape that matches, or null."""
    return F.coalesce(*[capture(log, shape, needs) for shape, needs in USER_SHAPES])
