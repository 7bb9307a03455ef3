"""The steps from CSV files to segments as jobs for spark-submit.

    spark-submit -m segmill.jobs ingest    --csv DIR --events DIR --quarantine DIR
    spark-submit -m segmill.jobs customers --events DIR --customers DIR --as-of 2020-05-01
    spark-submit -m segmill.jobs elbow     --customers DIR --out DIR
    spark-submit -m segmill.jobs segments  --customers DIR --model DIR --centres DIR --out DIR
    spark-submit -m segmill.jobs label     --customers DIR --model DIR --centres DIR --out DIR --first 0 --last 2000
    spark-submit -m segmill.jobs density   --customers DIR --out DIR

Every DIR is a path on shared storage. Outputs are Parquet tables.
"""

from __future__ import annotations

import argparse

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.operators import clustering, density, features, metrics, projection
from segmill.session import build_session, materialize, shuffle_partitions
from segmill.sources import csv_events, tables
from segmill.streaming.ingest import ingest_files


def ingest(spark: SparkSession, csv: str, events: str, quarantine: str, scope: str = "file") -> DataFrame:
    """Takes in the files of a folder that are not in the report yet, as the next batch; returns its report.

    The report is written last. A run that fails before is not in it, so the next run
    takes the same files and the same number and replaces what the failed one left.
    """
    report = f"{events.rstrip('/')}_report"
    done, batch = _reported(spark, report)
    files, others = csv_events.csv_entries(spark, csv)
    paths = [path for path in files if path not in done]
    failed = [(csv_events.source_name(spark, path), "not a file") for path in others if path not in done]
    ingest_files(spark, paths, events, quarantine, report, batch, scope, failed)
    return spark.read.parquet(f"{report}/{tables.BATCH_COLUMN}={batch}")


def _reported(spark: SparkSession, report: str) -> tuple[set[str], int]:
    """Files in the report, and the number of the batch that follows."""
    if not _exists(spark, report):
        return set(), 0
    rows = spark.read.parquet(report).select(csv_events.SOURCE_COLUMN, tables.BATCH_COLUMN).collect()
    files = {csv_events.plain_path(spark, row[0]) for row in rows}
    return files, max((row[1] for row in rows), default=-1) + 1


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def bytes_under(spark: SparkSession, path: str) -> int:
    """Size of the files under a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def customers(spark: SparkSession, events: str, customers: str, as_of: str) -> None:
    found = metrics.customer_metrics(tables.read_events(spark, events), as_of)
    tables.write_customers_path(found, customers)


def _matrix(spark: SparkSession, customers: str, model: str | None = None) -> DataFrame:
    table = tables.read_customers(spark, customers)
    fitted = features.fit_preprocessor(table)
    if model:
        tables.save_model(fitted, model)
    encoded = features.feature_matrix(table, fitted)
    return materialize(encoded.repartitionByRange("id_client").sortWithinPartitions("id_client"), "matrix")


def elbow(spark: SparkSession, customers: str, out: str) -> None:
    curve = clustering.kmeans_elbow(_matrix(spark, customers))
    curve.coalesce(1).write.mode("overwrite").parquet(out)


def segments(
    spark: SparkSession, customers: str, model: str, centres: str, out: str, k: int = 4, batch_ids: int | None = None
) -> None:
    """Mini-batch k-means over all customers, its state, and every customer's segment and score."""
    matrix = _matrix(spark, customers, model)
    found, weights = clustering.minibatch_kmeans(matrix, k, batch_ids)
    tables.save_centres(clustering.centres_frame(spark, found, weights), centres)
    labelled = clustering.with_labels(matrix, found)
    projection.cluster_scatter(labelled).write.mode("overwrite").parquet(out)


def label(spark: SparkSession, customers: str, model: str, centres: str, out: str, first: int, last: int) -> None:
    """Clusters of the customers of an id range, both ends included, by a stored model and its centres."""
    rows = tables.customers_by_id_range(tables.read_customers(spark, customers), first, last)
    matrix = features.feature_matrix(rows, PipelineModel.load(model))
    found, _ = clustering.centres_from_frame(tables.load_centres(spark, centres))
    clustering.assign_clusters(matrix, found).write.mode("overwrite").parquet(out)


def density_labels(spark: SparkSession, customers: str, out: str, min_size: int = 10, share: float = 0.5) -> None:
    """Density clusters, -1 for noise, in the plane of the principal components."""
    scores = projection.pca_2d(_matrix(spark, customers)).withColumnsRenamed({"pc1": "x", "pc2": "y"})
    points = materialize(scores, "points")
    eps = density.eps_by_k_distance(points, min_size, share)
    labels = density.density_clusters(points, eps, min_size, min_size)
    labels.withColumn("eps", F.lit(eps)).write.mode("overwrite").parquet(out)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--input-bytes", type=int, help="size of the input, where it is not that of its files")
    steps = parser.add_subparsers(dest="step", required=True)
    for step, names in {
        "ingest": ["csv", "events", "quarantine"],
        "customers": ["events", "customers", "as-of"],
        "elbow": ["customers", "out"],
        "segments": ["customers", "model", "centres", "out"],
        "label": ["customers", "model", "centres", "out"],
        "density": ["customers", "out"],
    }.items():
        command = steps.add_parser(step)
        for name in names:
            command.add_argument(f"--{name}", required=True)
        if step == "ingest":
            command.add_argument("--scope", choices=["file", "global"], default="file")
        if step == "segments":
            command.add_argument("--k", type=int, default=4)
            command.add_argument("--batch-ids", type=int)
        if step == "label":
            command.add_argument("--first", type=int, required=True)
            command.add_argument("--last", type=int, required=True)
    given = vars(parser.parse_args())
    step, input_bytes = given.pop("step"), given.pop("input_bytes")
    spark = build_session(f"segmill-{step}")
    source = given[{"ingest": "csv", "customers": "events"}.get(step, "customers")]
    size = input_bytes or bytes_under(spark, source)
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions(size)))
    run = {
        "ingest": ingest,
        "customers": customers,
        "elbow": elbow,
        "segments": segments,
        "label": label,
        "density": density_labels,
    }
    run[step](spark, **given)


if __name__ == "__main__":
    main()
