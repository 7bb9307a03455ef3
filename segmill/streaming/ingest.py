"""The CSV folder into the events table, file batch by file batch, as a job or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from segmill.operators.cleaning import DEDUP_KEYS, clean_unique, dedup_events, drop_unused
from segmill.schemas import RAW_COLUMNS
from segmill.session import materialize
from segmill.sources.csv_events import (
    REASON_COLUMN,
    SOURCE_COLUMN,
    accepted_rows,
    clean_scanned,
    ingest_report,
    land_scanned,
    plain_path,
    rejected_rows,
)
from segmill.sources.stored_keys import batches_at, not_stored, write_keys
from segmill.sources.tables import (
    BATCH_COLUMN,
    BATCHED_EVENTS_SCHEMA,
    MONTH_COLUMN,
    laid_out_events,
    replace_batch,
)

LATE = "later than the watermark"


def ingest_files(
    spark: SparkSession,
    paths: list[str],
    events: str,
    quarantine: str,
    report: str,
    batch: int,
    scope: str = "file",
    failed: list[tuple[str, str]] = (),
) -> None:
    """Takes files in as one batch: events, their keys, rejected rows and, last, the report per file.

    The files are parsed once and the events cleaned once; all outputs start from what was
    written of these. With ``scope="global"`` events that an earlier batch has stored are
    copies too. ``failed`` names files known to be unreadable, for the report.
    """
    scanned, files = land_scanned(spark, paths)
    cleaned = materialize(clean_scanned(scanned, scope), "cleaned")
    if scope == "global":
        cleaned = materialize(not_stored(cleaned, events, batch), "unknown")
    replace_batch(laid_out_events(cleaned), events, batch, MONTH_COLUMN)
    write_keys(cleaned, cleaned.count(), events, batch)
    replace_batch(rejected_rows(scanned), quarantine, batch)
    replace_batch(ingest_report(scanned, scope, cleaned, [*files, *failed]), report, batch)


def _new_files(spark: SparkSession, folder: str, files_per_batch: int) -> DataFrame:
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", "*.csv")
        .text(folder)
        .select("_metadata.file_path")
    )


def _paths(batch: DataFrame) -> list[str]:
    return [plain_path(batch.sparkSession, row[0]) for row in batch.distinct().collect()]


def stream_ingest(
    spark: SparkSession,
    folder: str,
    table_path: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    lateness: str | None = None,
) -> StreamingQuery:
    """Starts a query that takes in every new file of ``folder`` once, then stops.

    Rejected rows and the report per file go beside the table, into ``_quarantine`` and
    ``_report``. A batch that is run again replaces what it wrote. The stream only tells
    which files are new; each batch reads its files by their headers, once.

    Without ``lateness`` copies are removed within a file, and a file is never split over
    batches: no state is kept and nothing arrives too late.

    With it (such as ``"2 days"``) copies are removed over all files and batches, the first
    to arrive stays. Keys of the events are kept as state until the greatest event time seen
    is ``lateness`` ahead of them; a row that far behind when its batch begins could be
    a copy of a forgotten one and goes to the quarantine as late.
    """
    beside = table_path.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, paths = batch.sparkSession, _paths(batch)
        if lateness is None:
            ingest_files(spark, paths, table_path, f"{beside}_quarantine", f"{beside}_report", batch_id)
            return
        _land(spark, paths, beside, batch_id, lateness)
        _dedup_landed(spark, beside, f"{checkpoint.rstrip('/')}_state", lateness).awaitTermination()
        _report_landed(spark, beside, batch_id)

    return (
        _new_files(spark, folder, files_per_batch)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _seen_before(spark: SparkSession, beside: str, batch: int) -> int | None:
    """The greatest event time, in milliseconds, of the batches before this one."""
    path = f"{beside}_seen"
    earlier = [b for b in batches_at(spark, path) if b < batch]
    if not earlier:
        return None
    seen = spark.read.schema(f"latest_ms long, {BATCH_COLUMN} int").parquet(path)
    return seen.where(F.col(BATCH_COLUMN).isin(earlier)).agg(F.max("latest_ms")).first()[0]


def _land(spark: SparkSession, paths: list[str], beside: str, batch: int, lateness: str) -> None:
    """Writes a batch's rows that are not late, one per event key, for the deduplicating stream.

    Rows without a price stay: as first copies they take their key with them. The rows are
    written last and only once, as the other stream may have begun to read them.
    """
    landed = f"{beside}_landed/{BATCH_COLUMN}={batch}"
    if _exists(spark, f"{landed}/_SUCCESS"):
        return
    scanned, files = land_scanned(spark, paths)
    latest = _seen_before(spark, beside, batch)
    if latest is not None:
        # at the watermark itself a key may already be forgotten
        watermark = F.timestamp_millis(F.lit(latest)) - F.expr(f"interval {lateness}")
        late = F.col(REASON_COLUMN).isNull() & (F.col("event_time") <= watermark)
        as_read = F.to_json(F.struct(*RAW_COLUMNS))
        scanned = scanned.withColumns(
            {
                "raw_row": F.when(late, as_read).otherwise(F.col("raw_row")),
                REASON_COLUMN: F.when(late, F.lit(LATE)).otherwise(F.col(REASON_COLUMN)),
            }
        )
    good = accepted_rows(scanned)
    replace_batch(good.agg(F.unix_millis(F.max("event_time")).alias("latest_ms")), f"{beside}_seen", batch)
    replace_batch(rejected_rows(scanned), f"{beside}_quarantine", batch)
    nothing = good.limit(0)
    replace_batch(ingest_report(scanned, "global", nothing, files), f"{beside}_read", batch)
    first = dedup_events(drop_unused(good), F.struct(SOURCE_COLUMN, "ordinal")).drop("ordinal")
    replace_batch(first, f"{beside}_landed", batch)


LANDED_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.FloatType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_session", T.StringType()),
        T.StructField(SOURCE_COLUMN, T.StringType()),
        T.StructField(BATCH_COLUMN, T.IntegerType()),
    ]
)


def _dedup_landed(spark: SparkSession, beside: str, checkpoint: str, lateness: str) -> StreamingQuery:
    """Starts the stateful stream over what has landed: the first row of each event key goes on."""

    def store(batch: DataFrame, batch_id: int) -> None:
        first = materialize(batch, "first")
        if first.isEmpty():
            return
        cleaned = materialize(clean_unique(first), "cleaned")
        replace_batch(laid_out_events(cleaned), beside, batch_id, MONTH_COLUMN)
        replace_batch(cleaned.groupBy(SOURCE_COLUMN).count(), f"{beside}_inserted", batch_id)

    return (
        spark.readStream.schema(LANDED_SCHEMA)
        .parquet(f"{beside}_landed")
        .withWatermark("event_time", lateness)
        .dropDuplicatesWithinWatermark(DEDUP_KEYS)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _report_landed(spark: SparkSession, beside: str, batch: int) -> None:
    """The report of a batch, once its rows have been stored."""
    read = spark.read.parquet(f"{beside}_read/{BATCH_COLUMN}={batch}").drop("rows_inserted")
    if _exists(spark, f"{beside}_inserted"):
        stored = spark.read.schema(f"{SOURCE_COLUMN} string, count long").parquet(f"{beside}_inserted")
        inserted = stored.groupBy(SOURCE_COLUMN).agg(F.sum("count").alias("rows_inserted"))
        found = read.join(inserted, SOURCE_COLUMN, "left").fillna(0, subset=["rows_inserted"])
    else:
        found = read.withColumn("rows_inserted", F.lit(0).cast("long"))
    replace_batch(found, f"{beside}_report", batch)


def read_streamed_events(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.schema(BATCHED_EVENTS_SCHEMA).parquet(table_path)
