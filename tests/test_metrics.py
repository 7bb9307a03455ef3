import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from segmill.operators import enrich, ids, metrics, toplist

SCHEMA = (
    "event_time timestamp, event_type string, product_id long, brand string, price double, "
    "user_id long, user_session string, category_code_1 string"
)
SUNDAY = datetime(2020, 1, 5)


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def event(seconds, kind, product=1, price=1.0, user=1, session="s", brand="b", category="c"):
    return (SUNDAY + timedelta(seconds=seconds), kind, product, brand, price, user, session, category)


def one(spark, rows, **kwargs):
    found = metrics.customer_metrics(events(spark, rows), "2020-02-01", **kwargs).collect()
    assert len(found) == 1
    return found[0]


def test_gaps_of_a_user_without_views_carts_purchases(spark):
    only_view = one(spark, [event(0, "view")])
    assert (only_view["n_clicks"], only_view["n_carts"], only_view["n_purchases"]) == (1, 0, 0)
    assert only_view["cart_to_click_ratio"] == 0.0
    assert only_view["purchase_to_cart_ratio"] is None
    assert only_view["total_spent"] == 0.0
    assert only_view["avg_item_value"] is None
    assert only_view["avg_decision_delay_sec"] is None
    assert only_view["product_revisit_rate"] == 0.0
    only_cart = one(spark, [event(0, "cart")])
    assert only_cart["cart_to_click_ratio"] is None
    assert only_cart["product_revisit_rate"] is None


def test_purchase_before_cart_is_negative_and_weighted_by_rows(spark):
    rows = [event(100, "cart"), event(40, "purchase"), event(200, "view")]
    rows += [event(0, "cart", product=2), event(30, "purchase", product=2)]
    assert one(spark, rows)["avg_decision_delay_sec"] == pytest.approx((3 * -60 + 2 * 30) / 5)


def test_second_and_day_boundaries(spark):
    assert one(spark, [event(0.9, "cart"), event(1.1, "purchase")])["avg_decision_delay_sec"] == 1.0
    row = one(spark, [event(86399, "view"), event(86401, "view")])
    assert row["user_lifespan_days"] == 1.0
    assert row["recency_days"] == 26.0


def test_session_length_is_a_mean_over_events(spark):
    rows = [event(s, "view", session="long") for s in (0, 10, 100)] + [event(500, "view", session="short")]
    row = one(spark, rows)
    assert row["avg_session_len_sec"] == pytest.approx(75.0)
    assert row["n_sessions"] == 2


def test_modes_take_the_smallest_of_a_tie(spark):
    rows = [event(3600 * h, "view", brand=b, category=c) for h, b, c in [(9, "z", "q"), (9, "a", "p"), (3, "z", "p"), (3, "a", "q")]]
    row = one(spark, rows)
    assert (row["modal_hour"], row["modal_weekday"]) == (3, 7)
    assert (row["most_common_brand"], row["most_common_category"]) == ("a", "p")


def test_top_list_boundary_tie_and_nulls(spark):
    rows = [event(i, "view", brand=b) for i, b in enumerate(["b", "b", "c", "a", None, None, None])]
    assert [r["brand"] for r in toplist.top_brands(events(spark, rows), 2).collect()] == ["b", "a"]
    folded = toplist.collapse_rare_brand(events(spark, rows), 2)
    assert [r["brand_clean"] for r in folded.orderBy("event_time").collect()] == ["b", "b", "Other", "a"] + ["Other"] * 3


def test_other_competes_for_the_mode(spark):
    rows = [event(i, "view", brand=b) for i, b in enumerate(["a", "a", "x", "y", "z"])]
    row = one(spark, rows, n_brands=1)
    assert row["most_common_brand"] == "Other"


def random_events(spark, seed, n=800):
    rng = random.Random(seed)
    rows = [
        event(
            rng.randrange(0, 86400 * 20) + rng.random(),
            rng.choice(["view", "cart", "purchase", "other"]),
            product=rng.randrange(12),
            price=rng.random() * 100,
            user=rng.choice([1] * 10 + list(range(2, 12))),
            session=str(rng.randrange(9)),
            brand=rng.choice("abcdefg"),
            category=rng.choice("pqrst"),
        )
        for _ in range(n)
    ]
    return events(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_group_form_equals_per_event_form(spark, seed):
    df = random_events(spark, seed)
    rows = enrich.with_session_bounds(enrich.with_product_totals(df))
    length = (F.unix_micros("session_end") - F.unix_micros("session_start")) / 1e6
    delay = F.unix_seconds("purchase_time") - F.unix_seconds("cart_time")
    viewed = F.col("event_type") == "view"
    per_event = rows.groupBy("user_id").agg(
        F.avg(length).alias("length"),
        F.avg(delay).alias("delay"),
        (F.count_if(viewed & (F.col("views_per_product") > 1)) / F.count_if(viewed)).alias("revisit"),
    )
    grouped = metrics.user_metrics(df, "2020-02-01")
    joined = grouped.join(per_event, "user_id").collect()
    assert len(joined) == 11
    for r in joined:
        assert r["avg_session_len_sec"] == pytest.approx(r["length"], rel=1e-9)
        assert r["avg_decision_delay_sec"] == pytest.approx(r["delay"], rel=1e-9)
        assert r["product_revisit_rate"] == pytest.approx(r["revisit"], rel=1e-9)


def test_ids_are_dense_and_in_user_order(spark):
    users = spark.range(5000).select((F.col("id") * 7 + 3).alias("user_id")).repartition(13)
    found = ids.assign_customer_id(users).orderBy("user_id").collect()
    assert [r["id_client"] for r in found] == list(range(5000))
    again = ids.assign_customer_id(users.limit(0))
    assert again.count() == 0


def test_flagship_plan(spark):
    df = random_events(spark, 3)
    plan = metrics.user_metrics(df, "2020-02-01")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
