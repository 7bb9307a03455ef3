"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that CSV readers of the data-frame kind take as missing.
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

UNKNOWN = "unknown"


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(MISSING_TEXTS), text)


def normalise_text(text: Column) -> Column:
    """Lower case, outer white space off (tabs and newlines too), blanks to ``unknown``."""
    cleaned = F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")
    return F.when(cleaned.isNull() | cleaned.isin("", "nan"), F.lit(UNKNOWN)).otherwise(cleaned)


def category_level(path: Column, level: int) -> Column:
    """1-based level of a dotted path; null past its end, ``""`` for an empty segment."""
    return F.get(F.split(path, r"\."), F.lit(level - 1))


def category_depth(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is null, not an error, for a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


def day_difference(start: Column, end: Column) -> Column:
    """Midnights crossed from ``start`` to ``end``."""
    return F.datediff(end, start)


def second_difference(start: Column, end: Column) -> Column:
    """Second boundaries crossed, which is not the whole part of the elapsed time."""
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Elapsed time with its fraction."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1e6)


def iso_weekday(moment: Column) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return F.weekday(moment) + 1


def month_of(moment: Column) -> Column:
    """``yyyyMM`` as text, the partition value of the events table."""
    return F.date_format(moment, "yyyyMM")


def parse_event_time(text: Column) -> Column:
    """``2019-10-01 00:00:00 UTC`` or an ISO form; null when neither fits."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss 'UTC'")),
        text.try_cast("timestamp"),
    )
