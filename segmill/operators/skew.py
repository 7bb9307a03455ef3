"""Bringing group totals back to every row of the group, hot groups included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A group is hot once it holds more than 1/SLICES of all rows, so there are
# fewer than SLICES hot groups whatever the data: that bounds the broadcast.
SLICES = 10_000


def is_hot(whole: Column, count: str = "n") -> Column:
    return F.col(count) * F.lit(SLICES) > whole


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[prefix + key])
    return condition


def _prefixed(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns])


def join_totals(
    rows: DataFrame,
    totals: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    count: str = "n",
    n_rows: int | None = None,
) -> DataFrame:
    """``rows`` plus the ``values`` of their group in ``totals`` (one row per group, its size in ``count``).

    Same result as a whole-partition window, which would hold a group in one
    task. Here the few hot groups are broadcast and all others come through a
    shuffle join. In that shuffle the rows of hot groups, which need nothing
    from it, go to tasks by a scatter number. It comes from the row's content
    and its input partition, so exact copies spread as well, and a retried
    task sends every row where it went before.

    ``n_rows``, when the caller has counted, spares the count.
    """
    columns = rows.columns
    whole = F.lit(n_rows) if n_rows is not None else rows.agg(F.count("*")).scalar()
    # Both sides of the split use the same columns in the same order (the count
    # first, as in ``totals``), so the shuffle of the totals runs once.
    flagged = totals.select(*keys, is_hot(whole, count).alias("hot"), *values)
    hot = _prefixed(flagged.where("hot"), flagged.columns, "_h_")
    # The lane is part of the join key: 0 for a cold group and its rows, 1 for the
    # totals of a hot group, from 2 on for its rows.
    cold = _prefixed(flagged.withColumn("lane", F.col("hot").cast("int")), [*keys, "lane", *values], "_c_")

    scattered = F.pmod(F.xxhash64(*[F.col(c) for c in columns]) + F.spark_partition_id(), F.lit(2**31 - 3)) + 2
    left = rows.withColumn("_scatter", scattered.cast("int"))
    left = left.join(F.broadcast(hot), _match(left, hot, keys, "_h_"), "left")
    left = left.withColumn("_lane", F.when(F.col("_h_hot"), F.col("_scatter")).otherwise(0))
    joined = left.join(cold, _match(left, cold, keys, "_c_") & (left["_lane"] == cold["_c_lane"]), "left")
    return joined.select(
        *columns, *[F.when(F.col("_h_hot"), F.col(f"_h_{v}")).otherwise(F.col(f"_c_{v}")).alias(v) for v in values]
    )
