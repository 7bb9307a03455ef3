"""Most frequent values and the folding of all others into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER = "Other"
TOP_BRANDS = 50
TOP_CATEGORIES = 20


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; of equally frequent ones the smaller."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(n)
    )


def top_brands(events: DataFrame, n: int = TOP_BRANDS) -> DataFrame:
    return top_values(events, "brand", n)


def top_categories(events: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    return top_values(events, "category_code_1", n)


def collapse_rare(df: DataFrame, column: str, n: int, into: str, other: str = OTHER) -> DataFrame:
    """Adds ``into``: the value when it is among the top ``n`` of ``df``, else ``other``.

    The broadcast side has at most ``n`` rows.
    """
    kept = top_values(df, column, n).select(F.col(column).alias("_kept"))
    joined = df.join(F.broadcast(kept), F.col(column) == F.col("_kept"), "left")
    return joined.withColumn(into, F.coalesce("_kept", F.lit(other))).drop("_kept")


def collapse_rare_brand(events: DataFrame, n: int = TOP_BRANDS) -> DataFrame:
    return collapse_rare(events, "brand", n, "brand_clean")


def collapse_rare_category(events: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    return collapse_rare(events, "category_code_1", n, "category_code_1_clean")
