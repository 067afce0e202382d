"""Tolerant timestamp parsing of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed list of accepted layouts besides ISO 8601, in order of preference.
LAYOUTS = (
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "dd-MMM-yyyy",
    "dd MMM yyyy",
    "yyyyMMdd",
)


# A time begins with a digit, after blanks and perhaps a sign or the mark of a time of day.
_BEGINS = r"^[\x00-\x20]*[Tt+-]?\d"
# No accepted form is longer, blanks aside.
LONGEST = 64


def may_be_time(text: Column) -> Column:
    """Whether some layout could fit, from the value's shape alone."""
    return (F.length(text) <= LONGEST) & text.rlike(_BEGINS)


def parse_attempts(text: Column) -> list[Column]:
    """One nullable timestamp per layout; ISO needs a dash so plain numbers stay numbers.

    Each layout is tried only on values that hold its separators.
    """
    dash, slash, letter = text.contains("-"), text.contains("/"), text.rlike("[A-Za-z]")
    shapes = {"/": slash, "-": dash & letter, " ": text.contains(" ") & letter}
    attempts = [F.when(dash, F.try_to_timestamp(text))]
    for layout in LAYOUTS:
        separator = next((mark for mark in "/- " if mark in layout), None)
        shape = shapes[separator] if separator else text.rlike(r"^[+]?\d{8,}$")
        attempts.append(F.when(shape, F.try_to_timestamp(text, F.lit(layout))))
    return attempts


def best_layout(text: Column) -> Column:
    """As an aggregate: the layout that reads most values, of equals the one preferred."""
    counts = F.array(*[F.count(attempt) for attempt in parse_attempts(text)])
    return F.array_position(counts, F.array_max(counts)) - 1


def parse_by_layout(text: Column, layout: Column) -> Column:
    """Only this layout is tried, so days and months are never mixed up; NULL if it does not fit."""
    value = F.lit(None).cast("timestamp")
    for number, attempt in enumerate(parse_attempts(text)):
        value = F.when(layout == number, attempt).otherwise(value)
    return value
