"""Registered queries: one per operator, over the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill import jobs
from segmill.operators import (
    cleaning,
    clustering,
    density,
    enrich,
    features,
    metrics,
    profile,
    projection,
    toplist,
)
from segmill.plans import settings as s
from segmill.plans.oracle import ROUNDED
from segmill.plans.views import clickstream, dirty_clickstream
from segmill.schemas import EVENTS_SCHEMA, NUMERIC_FEATURES, RAW_COLUMNS
from segmill.session import materialize, scratch_path
from segmill.sources import csv_events, tables
from segmill.streaming.ingest import LATE, read_streamed_events, stream_ingest
from segmill.streaming.minibatch import read_centres, stream_minibatch_kmeans

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, ROUNDED[c]) for c in df.columns if c in ROUNDED})


def _on_clicks(
    operator: Callable[..., DataFrame], *args, columns: list[str] | None = None, stored: bool = False
) -> Query:
    """``stored`` writes the view first, for operators that read it several times."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = clickstream(spark, sf_dir)
        result = _rounded(operator(materialize(events, "events") if stored else events, *args))
        return result.select(*columns) if columns else result

    return run


def _on_dirty(operator: Callable[[DataFrame], DataFrame], columns: list[str] | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = operator(dirty_clickstream(spark, sf_dir))
        return result.select(*columns) if columns else result

    return run


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view is written first: the metrics and top lists read the events five times."""
    events = materialize(clickstream(spark, sf_dir), "events")
    return metrics.customer_metrics(events, s.AS_OF, s.N_BRANDS, s.N_CATEGORIES)


def stored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers table as later jobs see it: written, then read back."""
    path = scratch_path(spark, "customers")
    tables.write_customers_path(customers(spark, sf_dir), path)
    return tables.read_customers(spark, path)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix, written once for the many passes of a fit."""
    table = stored_customers(spark, sf_dir)
    return materialize(features.feature_matrix(table, features.fit_preprocessor(table)), "matrix")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(customers(spark, sf_dir))


def assigned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("id_client", "user_id")


def customers_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored_customers(spark, sf_dir)
    return _rounded(
        tables.customers_by_id_range(table, s.FIRST_ID, s.LAST_ID).select(
            "id_client", "user_id", "n_clicks", "total_spent"
        )
    )


def _customer_output(df: DataFrame) -> DataFrame:
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("first_event", "last_event")}
    return _rounded(df).withColumns(times)


def written_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_output(stored_customers(spark, sf_dir))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's tables after those of this data have been made, with what each holds."""
    key = uuid.uuid4().hex
    made = {f"listed_{key}_client": customers_in_catalog, f"listed_{key}_events": events_in_catalog}
    for name, make in made.items():
        make(spark, sf_dir, name)
    try:
        found = [name for name in tables.list_tables(spark) if name in made]
        counts = [spark.table(n).agg(F.lit(n[-6:]).alias("name"), F.count("*").alias("n_rows")) for n in found]
        return materialize(reduce(DataFrame.unionAll, counts), "listed")
    finally:
        for name in made:
            spark.sql(f"DROP TABLE {name}")


def customers_in_catalog(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The customers through an empty catalog table at a location of its own, which is returned."""
    path = scratch_path(spark, "client")
    tables.create_customer_table(spark, name, path)
    tables.insert_customers(customers(spark, sf_dir), name)
    return path


def events_in_catalog(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = scratch_path(spark, "events")
    tables.create_events_table(spark, name, path)
    tables.append_events(cleaning.clean_events(dirty_clickstream(spark, sf_dir)), name)
    return path


def created_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files outlive the table's name, which is dropped."""
    name = f"client_{uuid.uuid4().hex}"
    path = customers_in_catalog(spark, sf_dir, name)
    spark.sql(f"DROP TABLE {name}")
    return _customer_output(tables.read_customers(spark, path))


def split_levels(df: DataFrame) -> DataFrame:
    return cleaning.split_category(cleaning.normalise_strings(df))


LEVELS = [*(f"category_code_{i}" for i in range(1, 5)), "category_rest"]


def _written_csv(
    spark: SparkSession, sf_dir: str, path: str | None = None, parts: tuple = s.CSV_PARTS, files: int = 1
) -> str:
    """The dirty view as CSV files, at most ``files`` per part, some rows with an unreadable price.

    The copies of an event stay in one file, in their order. Returns a pattern for the folders.
    """
    path = path or scratch_path(spark, "csv")
    spoilt = F.when((F.col("ordinal") % 29 == 3) & F.col("price").isNotNull(), F.lit("12,5?"))
    rows = dirty_clickstream(spark, sf_dir).withColumns(
        {
            "event_time": F.date_format("event_time", "yyyy-MM-dd HH:mm:ss 'UTC'"),
            "price": F.coalesce(spoilt, F.col("price").cast("string")),
            "part": F.col("product_id") % len(s.CSV_PARTS),
        }
    )
    (
        rows.where(F.col("part").isin(*parts))
        .repartition("part", F.pmod(F.xxhash64("event_time", "user_id", "product_id"), F.lit(files)))
        .sortWithinPartitions("part", "ordinal")
        .select(*RAW_COLUMNS, "part")
        .write.partitionBy("part")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return f"{path}/*"


def _part() -> Column:
    return F.regexp_extract("source_file", "part=([0-9]+)", 1).cast("int").alias("part")


def _event_output(events: DataFrame) -> DataFrame:
    return events.select(*EVENTS_SCHEMA.names).withColumns(
        {
            "event_time": F.col("event_time").cast("timestamp_ntz"),
            "price": F.round(F.col("price").cast("double"), 2),
        }
    )


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = csv_events.scan_events_csv(spark, _written_csv(spark, sf_dir)).withColumns(
        {
            "event_time": F.col("event_time").cast("timestamp_ntz"),
            "price": F.round(F.col("price").cast("double"), 2),
        }
    )
    return scanned.select(_part(), *RAW_COLUMNS, "reject_reason")


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarantine as an ingest leaves it, its rows told by the number of their category."""
    path = scratch_path(spark, "events")
    jobs.ingest(spark, _written_csv(spark, sf_dir), path, f"{path}_quarantine")
    rows = spark.read.parquet(f"{path}_quarantine")
    read = [F.get_json_object("raw_row", f"$.{c}").alias(c) for c in ("category_id", "price")]
    return rows.select(_part(), "reject_reason", *read)


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_output(csv_events.ingest_folder(spark, _written_csv(spark, sf_dir)))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_file = csv_events.ingest_report(csv_events.scan_events_csv(spark, _written_csv(spark, sf_dir)))
    return per_file.select(_part(), "rows_read", "rows_rejected", "rows_too_deep", "rows_inserted")


def ingested_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the second with copies of events that the first has stored."""
    path = scratch_path(spark, "events")
    for parts in (s.FIRST_PARTS, s.CSV_PARTS):
        jobs.ingest(spark, _written_csv(spark, sf_dir, parts=parts), path, f"{path}_quarantine", "global")
    return _event_output(tables.read_events(spark, path))


def _streamed_twice(spark: SparkSession, sf_dir: str) -> str:
    """The table of a stream that keeps the keys it has seen; the second run brings copies and late rows."""
    folder, table, offsets = (scratch_path(spark, n) for n in ("csv", "streamed", "offsets"))
    for i, parts in enumerate((s.FIRST_PARTS, s.LATER_PARTS)):
        _written_csv(spark, sf_dir, f"{folder}/{i}", parts, s.STREAMED_FILES)
        stream_ingest(spark, f"{folder}/*/*", table, offsets, lateness=s.LATENESS).awaitTermination()
    return table


def streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_output(read_streamed_events(spark, _streamed_twice(spark, sf_dir)))


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{_streamed_twice(spark, sf_dir)}_quarantine")
    late = rows.where(F.col("reject_reason") == LATE)
    return late.select(_part(), F.get_json_object("raw_row", "$.category_id").cast("long").alias("category_id"))


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events")
    cleaned = cleaning.clean_events(dirty_clickstream(spark, sf_dir))
    tables.append_events_path(cleaned, path)
    return tables.read_events(spark, path)


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_output(_appended(spark, sf_dir))


def events_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_output(tables.events_between(_appended(spark, sf_dir), s.RANGE_START, s.RANGE_END))


def created_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"events_{uuid.uuid4().hex}"
    path = events_in_catalog(spark, sf_dir, name)
    spark.sql(f"DROP TABLE {name}")
    return _event_output(tables.read_events(spark, path))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, table = _written_csv(spark, sf_dir), scratch_path(spark, "streamed")
    stream_ingest(spark, folder, table, scratch_path(spark, "offsets"), files_per_batch=4).awaitTermination()
    return _event_output(read_streamed_events(spark, table))


def missing_counts(df: DataFrame) -> DataFrame:
    return profile.null_profile(df.drop("ordinal"))


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored_customers(spark, sf_dir)
    found = [
        profile.distinct_categories(table, c).select(F.lit(c).alias("column_name"), F.col(c).alias("value"))
        for c in ("most_common_category", "most_common_brand")
    ]
    return found[0].unionAll(found[1])


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.random_sample(clickstream(spark, sf_dir), 1000, seed=42, keys=["event_id"]).select("event_id", "user_id")


def previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.preview(clickstream(spark, sf_dir).select("event_id", "user_id"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.scaled_features(stored_customers(spark, sf_dir))


def scaled_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir).withColumns({f"{c}_z": F.round(f"{c}_z", 6) for c in NUMERIC_FEATURES})


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored_customers(spark, sf_dir)
    return features.one_hot_slots(table, features.fit_preprocessor(table))


def _nonzero_entries(df: DataFrame) -> DataFrame:
    """A matrix as rows ``id_client, position, value``, zeros left out."""
    entries = df.select("id_client", F.posexplode(vector_to_array("features")).alias("position", "value"))
    return entries.withColumn("value", F.round("value", 6)).where("value <> 0")


def matrix_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nonzero_entries(matrix(spark, sf_dir))


def reloaded_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of a stored and reloaded preprocessor."""
    table, path = stored_customers(spark, sf_dir), scratch_path(spark, "model")
    fitted = features.fit_preprocessor(table)
    tables.save_model(fitted, path)
    return _nonzero_entries(features.feature_matrix(table, type(fitted).load(path)))


def batch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored_customers(spark, sf_dir)
    model = features.fit_preprocessor(table)
    return _nonzero_entries(features.feature_batch(table, model, s.FIRST_ID, s.LAST_ID))


def _first_rows(rows: DataFrame) -> list[list[float]]:
    """The vectors of the first customers, as centres over all columns."""
    first = rows.where(F.col("id_client") < s.N_CENTRES).orderBy("id_client").select("features").collect()
    return [row["features"].toArray().tolist() for row in first]


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    return clustering.assign_clusters(rows, _first_rows(rows))


def _centres_long(frame: DataFrame) -> DataFrame:
    return frame.select("cluster", F.posexplode("center").alias("dim", "center"), "weight").withColumn(
        "center", F.round("center", 6)
    )


def one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    centres, weights = clustering.minibatch_step(rows, _first_rows(rows), s.CENTRE_WEIGHTS)
    return _centres_long(clustering.centres_frame(spark, centres, weights))


def minibatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres, weights = clustering.minibatch_kmeans(matrix(spark, sf_dir), k=4, seed=0)
    return _centres_long(clustering.centres_frame(spark, centres, weights))


def stream_minibatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, centres = scratch_path(spark, "matrix"), scratch_path(spark, "centres")
    table = stored_customers(spark, sf_dir)
    encoded = features.feature_matrix(table, features.fit_preprocessor(table))
    encoded.repartitionByRange(4, "id_client").write.parquet(path)
    stream_minibatch_kmeans(
        spark, path, centres, scratch_path(spark, "offsets"), k=4, files_per_batch=1
    ).awaitTermination()
    return _centres_long(read_centres(spark, centres))


def full_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans_fit_predict(matrix(spark, sf_dir), k=3, seed=42)


def elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans_elbow(matrix(spark, sf_dir)).withColumn("inertia", F.round("inertia", 4))


def inertia_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    inertia = clustering.total_inertia(matrix(spark, sf_dir))
    return spark.createDataFrame([(inertia,)], "inertia double").select(F.round("inertia", 6).alias("inertia"))


def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.pca_2d(matrix(spark, sf_dir)).select(
        "id_client", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2")
    )


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = projection.feature_covariance(matrix(spark, sf_dir))
    return found.withColumn("covariance", F.round("covariance", 6) + F.lit(0.0))


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = clustering.kmeans_labels(matrix(spark, sf_dir), k=3, seed=42)
    return projection.cluster_scatter(labelled)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (f"{c}_z" for c in s.DENSITY_COLUMNS)
    return materialize(
        scaled(spark, sf_dir).select("id_client", F.col(x).alias("x"), F.col(y).alias("y")), "points"
    )


def _point_output(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


def core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point_output(density.density_neighbours(_points(spark, sf_dir), s.EPS, s.MIN_POINTS))


def k_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _point_output(density.k_distances(_points(spark, sf_dir), s.MIN_POINTS))
    return found.withColumn("k_distance", F.round("k_distance", 6))


def hot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core points where thin cells look into cells that are cut into slices."""
    found = density.density_core_points(_points(spark, sf_dir), s.EPS, s.HOT_MIN_POINTS, s.HOT_SLICE_POINTS)
    return found.select("id_client", "is_core")


def _density_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density_clusters(_points(spark, sf_dir), s.EPS, s.MIN_POINTS, s.MIN_CLUSTER_SIZE)


def density_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point_output(_density_labels(spark, sf_dir))


def noise_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density_noise_share(_density_labels(spark, sf_dir)).withColumn("share", F.round("share", 6))


def density_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density labels in the plane of the principal components, with a radius found from the data."""
    scores = projection.pca_2d(matrix(spark, sf_dir))
    points = materialize(scores.withColumnsRenamed({"pc1": "x", "pc2": "y"}), "points")
    eps = density.eps_by_k_distance(points, s.MIN_POINTS, share=0.5)
    labelled = density.density_clusters(points, eps, s.MIN_POINTS, s.MIN_CLUSTER_SIZE)
    return labelled.withColumnsRenamed({"x": "pc1", "y": "pc2"})


def queries() -> dict[str, Query]:
    return {
        "customer_metrics": flagship,
        "funnel_counts": _on_clicks(metrics.funnel_counts),
        "funnel_ratios": _on_clicks(metrics.funnel_ratios),
        "user_distincts": _on_clicks(metrics.user_distincts, s.N_CATEGORIES),
        "user_modal_values": _on_clicks(metrics.user_modal_values, s.N_BRANDS, s.N_CATEGORIES),
        "user_spend": _on_clicks(metrics.user_spend),
        "session_length": _on_clicks(metrics.session_length),
        "user_lifespan": _on_clicks(metrics.user_lifespan, s.AS_OF),
        "decision_delay": _on_clicks(metrics.decision_delay),
        "revisit_rate": _on_clicks(metrics.revisit_rate),
        "assign_customer_id": assigned_ids,
        "customers_by_id_range": customers_in_range,
        "write_customers": written_customers,
        "create_customer_table": created_customers,
        "top_brands": _on_clicks(toplist.top_brands, s.N_BRANDS),
        "top_categories": _on_clicks(toplist.top_categories, s.N_CATEGORIES),
        "collapse_rare_brand": _on_clicks(
            toplist.collapse_rare_brand, s.N_BRANDS, columns=["event_id", "brand", "brand_clean"]
        ),
        "collapse_rare_category": _on_clicks(
            toplist.collapse_rare_category,
            s.N_CATEGORIES,
            columns=["event_id", "category_code_1", "category_code_1_clean"],
        ),
        "time_parts": _on_clicks(
            enrich.time_parts, columns=["event_id", "event_time", "hour", "weekday", "event_month"]
        ),
        "win_value_counts": _on_clicks(
            enrich.with_value_counts,
            s.N_BRANDS,
            s.N_CATEGORIES,
            columns=["event_id", "category_count", "brand_count", "hour_count", "weekday_count"],
            stored=True,
        ),
        "win_cart_purchase_time": _on_clicks(
            enrich.with_product_totals, columns=["event_id", "cart_time", "purchase_time"], stored=True
        ),
        "win_views_per_product": _on_clicks(
            enrich.with_product_totals, columns=["event_id", "views_per_product"], stored=True
        ),
        "win_session_bounds": _on_clicks(
            enrich.with_session_bounds, columns=["event_id", "session_start", "session_end"], stored=True
        ),
        "drop_unused": _on_dirty(cleaning.drop_unused),
        "dedup_events": _on_dirty(cleaning.dedup_events),
        "drop_missing": _on_dirty(cleaning.drop_missing),
        "normalise_strings": _on_dirty(cleaning.normalise_strings, ["ordinal", "brand", "category_code"]),
        "split_category": _on_dirty(split_levels, ["ordinal", *LEVELS]),
        "fill_category_levels": _on_dirty(
            lambda df: cleaning.fill_category_levels(split_levels(df)), ["ordinal", *LEVELS]
        ),
        "clean_events": _on_dirty(cleaning.clean_events, EVENTS_SCHEMA.names),
        "scan_events_csv": scan_csv,
        "ingest_folder": ingested,
        "quarantine": quarantined,
        "ingest_report": report,
        "ingest_global": ingested_twice,
        "list_tables": listed,
        "append_events": appended,
        "events_between": events_in_range,
        "create_events_table": created_events,
        "null_profile": _on_dirty(missing_counts),
        "distinct_categories": distinct_values,
        "random_sample": sampled,
        "preview": previewed,
        "scaled_features": scaled_output,
        "one_hot_features": one_hot,
        "feature_matrix": matrix_entries,
        "save_model": reloaded_model,
        "feature_batch": batch_entries,
        "assign_clusters": assigned,
        "minibatch_step": one_step,
        "minibatch_kmeans": minibatch,
        "kmeans_fit_predict": full_kmeans,
        "kmeans_elbow": elbow,
        "total_inertia": inertia_of_one,
        "pca_2d": principal_components,
        "feature_covariance": covariance,
        "cluster_scatter": scatter,
        "density_core_points": core_points,
        "k_distances": k_distances,
        "density_hot_cells": hot_cells,
        "density_clusters": density_labels,
        "density_noise_share": noise_share,
        "density_scatter": density_scatter,
        "stream_ingest": streamed,
        "stream_dedup": streamed_once,
        "stream_late_rows": late_rows,
        "stream_minibatch_kmeans": stream_minibatch,
    }
