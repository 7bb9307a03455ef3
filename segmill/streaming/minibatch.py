"""Incremental k-means over a growing feature table."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmill.operators.clustering import (
    CENTRES_SCHEMA,
    centres_frame,
    centres_from_frame,
    kmeans_fit,
    minibatch_step,
)

MATRIX_SCHEMA = T.StructType(
    [T.StructField("id_client", T.LongType()), T.StructField("features", VectorUDT())]
)


def read_centres(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The last version of the centres, or the last one older than batch ``before``."""
    versions = spark.read.schema(f"{CENTRES_SCHEMA}, batch long").parquet(path)
    if before is not None:
        versions = versions.where(F.col("batch") < before)
    return versions.where(F.col("batch") == versions.agg(F.max("batch")).scalar()).drop("batch")


def stream_minibatch_kmeans(
    spark: SparkSession,
    matrix_path: str,
    centres_path: str,
    checkpoint: str,
    k: int = 4,
    seed: int = 0,
    files_per_batch: int = 1000,
):
    """Starts a query that makes one k-means step per batch of new feature files.

    Each batch reads the version of the batch before it and writes its own, so
    running a batch again gives the same version again. Until there are ``k`` rows,
    batches wait beside the centres; the first fit and step take all that waited.
    """
    waiting = f"{centres_path.rstrip('/')}_waiting"

    def step(batch: DataFrame, batch_id: int) -> None:
        centres, weights = centres_from_frame(read_centres(spark, centres_path, batch_id))
        if not centres:
            batch.write.mode("overwrite").parquet(f"{waiting}/batch={batch_id}")
            waited = spark.read.schema(T.StructType([*MATRIX_SCHEMA, T.StructField("batch", T.LongType())])).parquet(waiting)
            batch = waited.where(F.col("batch") <= batch_id).drop("batch")
            if batch.limit(k).count() < k:
                return
            centres = kmeans_fit(batch, k, seed)
            weights = [0.0] * len(centres)
        centres, weights = minibatch_step(batch, centres, weights)
        centres_frame(spark, centres, weights).coalesce(1).write.mode("overwrite").parquet(
            f"{centres_path}/batch={batch_id}"
        )

    # an empty table, so that the first batch finds a folder to look into
    centres_frame(spark, [], []).withColumn("batch", F.lit(0)).write.mode("append").partitionBy(
        "batch"
    ).parquet(centres_path)
    stream = (
        spark.readStream.schema(MATRIX_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(matrix_path)
    )
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
