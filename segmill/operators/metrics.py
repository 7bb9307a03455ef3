"""One row of behaviour metrics per user.

Means over event rows are written as sums weighted by the row count of the
(user, product) or (user, session) group, so no step needs a window: every
shuffle carries partial aggregates, and a very active user is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions.scalars import (
    day_difference,
    elapsed_seconds,
    iso_weekday,
    ratio,
    second_difference,
)
from segmill.operators.ids import assign_customer_id
from segmill.operators.toplist import (
    TOP_BRANDS,
    TOP_CATEGORIES,
    collapse_rare_brand,
    collapse_rare_category,
)
from segmill.schemas import CUSTOMERS_SCHEMA
from segmill.session import materialize


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _purchase_price() -> Column:
    return F.when(_is("purchase"), F.col("price").cast("double"))


COUNTS = {"n_clicks": "view", "n_carts": "cart", "n_purchases": "purchase"}
RATIOS = {
    "cart_to_click_ratio": ("n_carts", "n_clicks"),
    "purchase_to_cart_ratio": ("n_purchases", "n_carts"),
    "purchase_to_click_ratio": ("n_purchases", "n_clicks"),
}


def _count_columns() -> list[Column]:
    return [F.count_if(_is(kind)).alias(name) for name, kind in COUNTS.items()]


def _ratio_columns() -> dict[str, Column]:
    return {name: ratio(F.col(a), F.col(b)) for name, (a, b) in RATIOS.items()}


def _spend_columns() -> list[Column]:
    return [
        F.coalesce(F.sum(_purchase_price()), F.lit(0.0)).alias("total_spent"),
        F.avg(_purchase_price()).alias("avg_item_value"),
    ]


def _lifetime_columns(as_of: Column) -> list[Column]:
    first, last = F.min("event_time"), F.max("event_time")
    return [
        day_difference(first, last).cast("double").alias("user_lifespan_days"),
        day_difference(last, as_of).cast("double").alias("recency_days"),
        first.alias("first_event"),
        last.alias("last_event"),
    ]


def _modal_columns() -> list[Column]:
    """Most frequent values, the smaller of equally frequent ones.

    The state per user is a value-to-count map of at most 51 entries, as the
    category and brand are folded before.
    """
    hour, weekday = F.hour("event_time"), iso_weekday(F.col("event_time"))
    return [
        F.mode("category_code_1_clean", True).alias("most_common_category"),
        F.mode("brand_clean", True).alias("most_common_brand"),
        F.mode(hour, True).cast("int").alias("modal_hour"),
        F.mode(weekday, True).cast("int").alias("modal_weekday"),
    ]


def _category_count() -> Column:
    return F.size(F.collect_set("category_code_1_clean")).cast("long").alias("unique_categories")


def known_users(events: DataFrame) -> DataFrame:
    """Events without a user count for top lists, but belong to no customer."""
    return events.where(F.col("user_id").isNotNull())


def funnel_counts(events: DataFrame) -> DataFrame:
    return known_users(events).groupBy("user_id").agg(*_count_columns())


def funnel_ratios(events: DataFrame) -> DataFrame:
    return funnel_counts(events).withColumns(_ratio_columns()).select("user_id", *RATIOS)


def product_metrics(events: DataFrame) -> DataFrame:
    """Distinct products, decision delay and revisit rate, through (user, product)."""
    per_product = known_users(events).groupBy("user_id", "product_id").agg(
        F.count("*").alias("n"),
        F.count_if(_is("view")).alias("views"),
        second_difference(
            F.min(F.when(_is("cart"), F.col("event_time"))),
            F.min(F.when(_is("purchase"), F.col("event_time"))),
        ).alias("delay"),
    )
    return per_product.groupBy("user_id").agg(
        F.count("product_id").alias("unique_products"),
        (F.sum(F.col("n") * F.col("delay")) / F.sum(F.when(F.col("delay").isNotNull(), F.col("n")))).alias(
            "avg_decision_delay_sec"
        ),
        ratio(F.sum(F.when(F.col("views") > 1, F.col("views")).otherwise(0)), F.sum("views")).alias(
            "product_revisit_rate"
        ),
    )


def session_metrics(events: DataFrame) -> DataFrame:
    """Number of sessions and mean session length over event rows."""
    per_session = known_users(events).groupBy("user_id", "user_session").agg(
        F.count("*").alias("n"),
        elapsed_seconds(F.min("event_time"), F.max("event_time")).alias("length"),
    )
    return per_session.groupBy("user_id").agg(
        F.count("user_session").alias("n_sessions"),
        (F.sum(F.col("n") * F.col("length")) / F.sum("n")).alias("avg_session_len_sec"),
    )


def user_distincts(events: DataFrame, n_categories: int = TOP_CATEGORIES) -> DataFrame:
    categories = known_users(collapse_rare_category(events, n_categories)).groupBy("user_id").agg(_category_count())
    return (
        categories.join(product_metrics(events), "user_id")
        .join(session_metrics(events), "user_id")
        .select("user_id", "unique_products", "unique_categories", "n_sessions")
    )


def user_modal_values(
    events: DataFrame, n_brands: int = TOP_BRANDS, n_categories: int = TOP_CATEGORIES
) -> DataFrame:
    folded = collapse_rare_category(collapse_rare_brand(events, n_brands), n_categories)
    return known_users(folded).groupBy("user_id").agg(*_modal_columns())


def user_spend(events: DataFrame) -> DataFrame:
    return known_users(events).groupBy("user_id").agg(*_spend_columns())


def session_length(events: DataFrame) -> DataFrame:
    return session_metrics(events).select("user_id", "avg_session_len_sec")


def user_lifespan(events: DataFrame, as_of: str) -> DataFrame:
    return known_users(events).groupBy("user_id").agg(*_lifetime_columns(F.lit(as_of).cast("date")))


def decision_delay(events: DataFrame) -> DataFrame:
    return product_metrics(events).select("user_id", "avg_decision_delay_sec")


def revisit_rate(events: DataFrame) -> DataFrame:
    return product_metrics(events).select("user_id", "product_revisit_rate")


def user_metrics(
    events: DataFrame,
    as_of: str,
    n_brands: int = TOP_BRANDS,
    n_categories: int = TOP_CATEGORIES,
) -> DataFrame:
    """All metrics by ``user_id``, without the dense id.

    Three branches over the events; each ends partitioned by user, so their
    joins need no further shuffle.
    """
    folded = collapse_rare_category(collapse_rare_brand(events, n_brands), n_categories)
    per_user = known_users(folded).groupBy("user_id").agg(
        *_count_columns(),
        _category_count(),
        *_modal_columns(),
        *_spend_columns(),
        *_lifetime_columns(F.lit(as_of).cast("date")),
    )
    return (
        per_user.withColumns(_ratio_columns())
        .join(product_metrics(events), "user_id")
        .join(session_metrics(events), "user_id")
    )


def customer_metrics(
    events: DataFrame,
    as_of: str,
    n_brands: int = TOP_BRANDS,
    n_categories: int = TOP_CATEGORIES,
) -> DataFrame:
    """The customers table: every metric plus ``id_client`` = 0 .. n-1 in user order."""
    # Written first: the ids sample their input, which would run the joins again.
    metrics = materialize(user_metrics(events, as_of, n_brands, n_categories), "metrics")
    return assign_customer_id(metrics).select(*CUSTOMERS_SCHEMA.names)
