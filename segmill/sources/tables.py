"""The events and customers tables, the quarantine and stored centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmill.functions.scalars import month_of
from segmill.schemas import CUSTOMERS_SCHEMA, EVENTS_SCHEMA

MONTH_COLUMN = "event_month"
BATCH_COLUMN = "ingest_batch"
STORED_EVENTS_SCHEMA = T.StructType([*EVENTS_SCHEMA.fields, T.StructField(MONTH_COLUMN, T.StringType())])
BATCHED_EVENTS_SCHEMA = T.StructType([*STORED_EVENTS_SCHEMA.fields, T.StructField(BATCH_COLUMN, T.IntegerType())])


def _create(spark: SparkSession, name: str, schema: T.StructType, partition: str, location: str | None) -> None:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{partition}{place}")


def create_events_table(spark: SparkSession, name: str = "events", location: str | None = None) -> None:
    """One directory per month; files are sorted by (event_time, user_id) on write."""
    _create(spark, name, STORED_EVENTS_SCHEMA, f" PARTITIONED BY ({MONTH_COLUMN})", location)


def create_customer_table(spark: SparkSession, name: str = "client", location: str | None = None) -> None:
    _create(spark, name, CUSTOMERS_SCHEMA, "", location)


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def laid_out_events(events: DataFrame) -> DataFrame:
    """Events in table order, ready to be written.

    Ranges of (event_time, user_id, ...) rather than one task per month: a
    month may hold most of the data. The last two columns make the range key
    unique after the dedup, so even one busy instant can be divided.
    """
    return (
        events.select(*EVENTS_SCHEMA.names)
        .to(EVENTS_SCHEMA)
        .withColumn(MONTH_COLUMN, month_of(F.col("event_time")))
        .repartitionByRange("event_time", "user_id", "product_id", "event_type")
        .sortWithinPartitions(MONTH_COLUMN, "event_time", "user_id")
    )


def append_events(events: DataFrame, name: str = "events") -> None:
    """Adds events to the catalog table, columns matched by name."""
    laid_out_events(events).write.mode("append").format("parquet").partitionBy(MONTH_COLUMN).saveAsTable(name)


def replace_batch(rows: DataFrame, path: str, batch: int, *partitions: str) -> None:
    """Writes a batch as a directory of its own; a repeated batch takes the place of the first."""
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path.rstrip('/')}/{BATCH_COLUMN}={batch}")


def append_events_path(events: DataFrame, path: str) -> None:
    laid_out_events(events).write.mode("append").partitionBy(MONTH_COLUMN).parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of a table, whether it has batches or not."""
    return spark.read.schema(STORED_EVENTS_SCHEMA).parquet(path).select(*STORED_EVENTS_SCHEMA.names)


def events_between(stored: DataFrame, start: str, end: str) -> DataFrame:
    """Events with ``start <= event_time < end``; only their months are listed and read."""
    begin, stop = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    months = F.col(MONTH_COLUMN).between(month_of(begin), month_of(stop))
    return stored.where(months & (F.col("event_time") >= begin) & (F.col("event_time") < stop))


def _laid_out_customers(customers: DataFrame) -> DataFrame:
    by_name = customers.select(*CUSTOMERS_SCHEMA.names).to(CUSTOMERS_SCHEMA)
    return by_name.repartitionByRange("id_client").sortWithinPartitions("id_client")


def write_customers(customers: DataFrame, name: str = "client") -> None:
    """Replaces the customers table; each file holds an id range of its own."""
    _laid_out_customers(customers).write.mode("overwrite").format("parquet").saveAsTable(name)


def insert_customers(customers: DataFrame, name: str = "client") -> None:
    """Adds customers to a catalog table, in its layout."""
    _laid_out_customers(customers).write.insertInto(name)


def write_customers_path(customers: DataFrame, path: str) -> None:
    _laid_out_customers(customers).write.mode("overwrite").parquet(path)


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CUSTOMERS_SCHEMA).parquet(path)


def customers_by_id_range(customers: DataFrame, start: int, end: int) -> DataFrame:
    """Customers with ``start <= id_client <= end``, both ends included."""
    return customers.where(F.col("id_client").between(start, end))


def save_centres(centres: DataFrame, path: str) -> None:
    """``cluster, center, weight``: the state of a mini-batch model."""
    centres.coalesce(1).write.mode("overwrite").parquet(path)


def load_centres(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cluster int, center array<double>, weight double").parquet(path)


def save_model(model, path: str) -> None:
    """A fitted Spark ML model; ``type(model).load(path)`` reads it back."""
    model.write().overwrite().save(path)
