from datetime import datetime

from pyspark.sql import functions as F

from segmill.operators.metrics import customer_metrics
from segmill.plans.views import dirty_clickstream
from segmill.operators.cleaning import clean_events
from segmill.schemas import CUSTOMERS_SCHEMA, EVENTS_SCHEMA
from segmill.sources import tables

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalog_tables(spark):
    tables.create_events_table(spark, "shop_events")
    tables.create_events_table(spark, "shop_events")
    tables.create_customer_table(spark, "shop_client")
    assert {"shop_events", "shop_client"} <= set(tables.list_tables(spark))
    assert spark.catalog.tableExists("shop_client")

    events = clean_events(dirty_clickstream(spark, SF_DIR))
    tables.append_events(events, "shop_events")
    n = events.count()
    assert spark.table("shop_events").count() == n
    tables.append_events(events.select(*reversed(EVENTS_SCHEMA.names)), "shop_events")
    assert spark.table("shop_events").count() == 2 * n

    metrics = customer_metrics(events, "2024-02-01")
    tables.write_customers(metrics, "shop_client")
    tables.write_customers(metrics.select(*reversed(CUSTOMERS_SCHEMA.names)), "shop_client")
    stored = spark.table("shop_client")
    assert stored.columns == CUSTOMERS_SCHEMA.names
    assert [r[0] for r in stored.select("id_client").orderBy("id_client").collect()] == list(range(15))
    assert stored.where(F.col("first_event") > F.col("last_event")).isEmpty()


def test_time_range_reads_its_months_only(spark, tmp_path):
    times = [datetime(2024, m, d) for m in range(1, 7) for d in (1, 15)]
    rows = [(t, "view", 1, "b", 1.0, 1, "s", "a", "b", "c", "d", None) for t in times]
    path = str(tmp_path / "events")
    tables.append_events_path(spark.createDataFrame(rows, EVENTS_SCHEMA), path)
    found = tables.events_between(tables.read_events(spark, path), "2024-02-10", "2024-04-01")
    assert [r["event_time"] for r in found.orderBy("event_time").collect()] == times[3:6]
    pruned = plan_of(found).split("PartitionFilters: [")[1].split("]")[0]
    assert ">= 202402" in pruned and "<= 202404" in pruned


def test_id_range_is_inclusive_and_pushed_down(spark, tmp_path):
    path = str(tmp_path / "client")
    customers = spark.range(1000).select(
        *[F.col("id").alias(f.name) if f.name == "id_client" else F.lit(None).cast(f.dataType).alias(f.name) for f in CUSTOMERS_SCHEMA]
    )
    tables.write_customers_path(customers, path)
    found = tables.customers_by_id_range(tables.read_customers(spark, path), 10, 20).select("id_client", "n_clicks")
    assert sorted(r["id_client"] for r in found.collect()) == list(range(10, 21))
    plan = plan_of(found)
    assert "GreaterThanOrEqual(id_client,10)" in plan and "LessThanOrEqual(id_client,20)" in plan
    assert "ReadSchema: struct<id_client:bigint,n_clicks:bigint>" in plan


def test_files_hold_disjoint_id_ranges(spark, tmp_path):
    path = str(tmp_path / "client")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        customers = spark.range(20_000).select(
            *[
                (F.col("id") * 7919 % 20_000 if f.name == "id_client" else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in CUSTOMERS_SCHEMA
            ]
        )
        tables.write_customers_path(customers.repartition(16), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ranges = (
        tables.read_customers(spark, path)
        .groupBy(F.input_file_name().alias("file"))
        .agg(F.min("id_client").alias("low"), F.max("id_client").alias("high"))
        .orderBy("low")
        .collect()
    )
    assert len(ranges) > 4
    assert all(a["high"] < b["low"] for a, b in zip(ranges, ranges[1:]))
