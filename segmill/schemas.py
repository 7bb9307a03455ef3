"""Table schemas and column lists."""

from __future__ import annotations

from pyspark.sql import types as T

CATEGORY_LEVELS = 4
LEVEL_COLUMNS = [f"category_code_{i}" for i in range(1, CATEGORY_LEVELS + 1)]
# What is left of a path behind the last level, null for most.
REST_COLUMN = "category_rest"

# Every raw field is read as text: typing happens after the missing-value
# markers are mapped, so that a bad value is told apart from a missing one.
RAW_COLUMNS = [
    "event_time",
    "event_type",
    "product_id",
    "category_id",
    "category_code",
    "brand",
    "price",
    "user_id",
    "user_session",
]
CORRUPT_COLUMN = "_corrupt_record"
EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.FloatType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_session", T.StringType()),
    ]
    + [T.StructField(name, T.StringType()) for name in [*LEVEL_COLUMNS, REST_COLUMN]]
)

CUSTOMERS_SCHEMA = T.StructType(
    [
        T.StructField("id_client", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("n_clicks", T.LongType()),
        T.StructField("n_carts", T.LongType()),
        T.StructField("n_purchases", T.LongType()),
        T.StructField("cart_to_click_ratio", T.DoubleType()),
        T.StructField("purchase_to_cart_ratio", T.DoubleType()),
        T.StructField("purchase_to_click_ratio", T.DoubleType()),
        T.StructField("unique_products", T.LongType()),
        T.StructField("unique_categories", T.LongType()),
        T.StructField("most_common_category", T.StringType()),
        T.StructField("most_common_brand", T.StringType()),
        T.StructField("n_sessions", T.LongType()),
        T.StructField("avg_session_len_sec", T.DoubleType()),
        T.StructField("user_lifespan_days", T.DoubleType()),
        T.StructField("avg_decision_delay_sec", T.DoubleType()),
        T.StructField("product_revisit_rate", T.DoubleType()),
        T.StructField("total_spent", T.DoubleType()),
        T.StructField("avg_item_value", T.DoubleType()),
        T.StructField("modal_hour", T.IntegerType()),
        T.StructField("modal_weekday", T.IntegerType()),
        T.StructField("recency_days", T.DoubleType()),
        T.StructField("first_event", T.TimestampType()),
        T.StructField("last_event", T.TimestampType()),
    ]
)

# The inputs of the feature matrix, in its column order.
NUMERIC_FEATURES = [
    "n_clicks",
    "n_carts",
    "n_purchases",
    "cart_to_click_ratio",
    "purchase_to_cart_ratio",
    "purchase_to_click_ratio",
    "unique_products",
    "unique_categories",
    "n_sessions",
    "avg_session_len_sec",
    "user_lifespan_days",
    "product_revisit_rate",
    "total_spent",
    "avg_item_value",
    "modal_hour",
    "modal_weekday",
    "recency_days",
]
# The inputs that are whole numbers.
INTEGER_FEATURES = [
    "n_clicks",
    "n_carts",
    "n_purchases",
    "unique_products",
    "unique_categories",
    "n_sessions",
    "modal_hour",
    "modal_weekday",
]
CATEGORICAL_FEATURES = ["most_common_category", "most_common_brand"]
