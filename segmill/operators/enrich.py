"""Per-event columns: time parts and totals of the event's groups.

Each operator gives what a window over the whole partition would, computed as
an aggregate with map-side combining that is joined back (see ``skew``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.functions.scalars import iso_weekday, month_of
from segmill.operators.skew import join_totals
from segmill.operators.toplist import (
    TOP_BRANDS,
    TOP_CATEGORIES,
    collapse_rare_brand,
    collapse_rare_category,
)


def time_parts(events: DataFrame) -> DataFrame:
    moment = F.col("event_time")
    return events.withColumns(
        {
            "hour": F.hour(moment),
            "weekday": iso_weekday(moment).cast("int"),
            "event_month": month_of(moment),
        }
    )


def with_value_counts(
    events: DataFrame, n_brands: int = TOP_BRANDS, n_categories: int = TOP_CATEGORIES
) -> DataFrame:
    """How many events of the same user share the category, brand, hour or weekday.

    All four come back in one join: per user a map from each value to its
    count. The folded columns and the calendar bound a map to
    ``n_categories + 1 + n_brands + 1 + 24 + 7`` entries.
    """
    folded = collapse_rare_category(collapse_rare_brand(events, n_brands), n_categories)
    rows = folded.withColumns(
        {"hour": F.hour("event_time"), "weekday": iso_weekday(F.col("event_time")).cast("int")}
    )
    counted = {
        "category_count": "category_code_1_clean",
        "brand_count": "brand_clean",
        "hour_count": "hour",
        "weekday_count": "weekday",
    }
    # a map has no null key; only the calendar columns can be null here
    known = rows.fillna(-1, subset=["hour", "weekday"])
    per_value = known.groupingSets([["user_id", c] for c in counted.values()], "user_id", *counted.values()).agg(
        F.count("*").alias("n"), *[F.grouping(c).alias(f"_{c}") for c in counted.values()]
    )
    per_user = per_value.groupBy("user_id").agg(
        # every event adds one to each of the four counts
        (F.sum("n") / len(counted)).cast("long").alias("n"),
        *[
            F.map_from_entries(F.collect_list(F.when(F.col(f"_{c}") == 0, F.struct(c, "n")))).alias(f"_{name}")
            for name, c in counted.items()
        ],
    )
    joined = join_totals(rows, per_user, ["user_id"], [f"_{name}" for name in counted])
    found = {
        name: F.element_at(f"_{name}", F.coalesce(c, F.lit(-1)) if c in ("hour", "weekday") else F.col(c))
        for name, c in counted.items()
    }
    return joined.withColumns(found).drop(*[f"_{name}" for name in counted])


def with_product_totals(events: DataFrame) -> DataFrame:
    """First cart, first purchase and number of views of the event's user and product."""
    totals = events.groupBy("user_id", "product_id").agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("event_type") == "cart", F.col("event_time"))).alias("cart_time"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("event_time"))).alias("purchase_time"),
        F.count_if(F.col("event_type") == "view").alias("views_per_product"),
    )
    return join_totals(
        events, totals, ["user_id", "product_id"], ["cart_time", "purchase_time", "views_per_product"]
    )


def with_session_bounds(events: DataFrame) -> DataFrame:
    """First and last event time of the event's session."""
    totals = events.groupBy("user_id", "user_session").agg(
        F.count("*").alias("n"),
        F.min("event_time").alias("session_start"),
        F.max("event_time").alias("session_end"),
    )
    return join_totals(events, totals, ["user_id", "user_session"], ["session_start", "session_end"])
