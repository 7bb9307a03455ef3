"""Looking at a table: null counts, distinct values, a preview, a sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_profile(df: DataFrame) -> DataFrame:
    """Columns with missing values (null or NaN) and how many, in one pass."""
    counts = []
    for field in df.schema:
        missing = F.col(field.name).isNull()
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            missing = missing | F.isnan(field.name)
        counts.append(F.count_if(missing).alias(field.name))
    wide = df.agg(*counts)
    return wide.unpivot([], df.columns, "column_name", "n_missing").where(F.col("n_missing") > 0)


def distinct_categories(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def random_sample(df: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """``n`` random rows (all rows when there are fewer), the same however ``df`` is partitioned.

    Those whose ``keys`` (all columns, where none are named) have the smallest seeded digests;
    rows that share these share their fate but for the last, where the whole row decides. Every
    task keeps ``n`` rows at most. Digests are even, so nearly all rows are passed over
    by a bound above which the ``n``-th cannot lie but by a chance of one in millions;
    should it do so, the rows are ranked without the bound.
    """
    names = list(keys) or df.columns
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    drawn = df.withColumn("_draw", F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts)))
    n_rows = df.count()
    likely = n + 6 * n**0.5 + 50
    if likely < n_rows:
        bound = f"{int(likely / n_rows * 2**60):015x}"
        near = drawn.where(F.col("_draw") < bound)
        if near.count() >= n:
            drawn = near
    order = [F.col("_draw"), *[F.col(c) for c in df.columns if c not in names], *[F.col(c) for c in names]]
    return drawn.orderBy(*order).limit(n).drop("_draw")
