"""Cleaning of raw events; the order of the steps is part of the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions.scalars import UNKNOWN, category_level, normalise_text
from segmill.schemas import CATEGORY_LEVELS, LEVEL_COLUMNS, REST_COLUMN

DEDUP_KEYS = ["event_time", "user_id", "product_id", "event_type"]
UNUSED_COLUMNS = ["category_id"]
REQUIRED_COLUMNS = ["price", "user_session"]
TEXT_COLUMNS = ["brand", "category_code"]


def drop_unused(df: DataFrame) -> DataFrame:
    return df.drop(*UNUSED_COLUMNS)


def dedup_events(
    df: DataFrame,
    ordinal: str | Column = "ordinal",
    scope: Sequence[str] = (),
) -> DataFrame:
    """The first row, by ``ordinal``, of each event key.

    ``scope`` adds columns to the key: ``["source_file"]`` removes copies
    within a file only. As an aggregate it keeps one row per key and task
    before the shuffle, so a key with very many copies costs no more than
    any other.
    """
    keys = [*DEDUP_KEYS, *scope]
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(ordinal) if isinstance(ordinal, str) else ordinal)
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*").select(*df.columns)


def drop_missing(df: DataFrame) -> DataFrame:
    """Runs after the dedup: a first copy without a price takes its key with it."""
    return df.dropna(subset=REQUIRED_COLUMNS)


def normalise_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: normalise_text(F.col(c)) for c in TEXT_COLUMNS})


def split_category(df: DataFrame) -> DataFrame:
    """The dotted path as one column per level, and what follows the last one."""
    path = F.col("category_code")
    levels = {name: category_level(path, i + 1) for i, name in enumerate(LEVEL_COLUMNS[:CATEGORY_LEVELS])}
    parts = F.split(path, "[.]")
    rest = F.array_join(F.slice(parts, CATEGORY_LEVELS + 1, F.size(parts)), ".")
    return df.withColumns(
        levels | {REST_COLUMN: F.when(F.size(parts) > CATEGORY_LEVELS, rest)}
    ).drop("category_code")


def fill_category_levels(df: DataFrame) -> DataFrame:
    return df.fillna(UNKNOWN, subset=LEVEL_COLUMNS[1:])


def clean_events(
    df: DataFrame,
    ordinal: str | Column = "ordinal",
    scope: Sequence[str] = (),
) -> DataFrame:
    """All steps: one shuffle for the dedup, then a narrow projection."""
    return clean_unique(dedup_events(drop_unused(df), ordinal, scope))


def clean_unique(unique: DataFrame) -> DataFrame:
    """The steps behind the dedup."""
    return fill_category_levels(split_category(normalise_strings(drop_missing(unique))))
