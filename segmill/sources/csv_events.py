"""Reading a folder of event CSV files, with bad rows set aside."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmill.functions.scalars import category_depth, missing_to_null, normalise_text, parse_event_time
from segmill.operators.cleaning import clean_events
from segmill.schemas import CATEGORY_LEVELS, CORRUPT_COLUMN, EVENTS_SCHEMA, RAW_COLUMNS
from segmill.session import materialize

SOURCE_COLUMN = "source_file"
REASON_COLUMN = "reject_reason"

# A row without one of these cannot be stored; a missing price or session is
# left to the cleaning step, which drops it after the dedup.
REQUIRED = ["event_time", "event_type", "product_id", "user_id"]


def _typed(df: DataFrame) -> DataFrame:
    """Types, plus why a row is unusable (null when it is fine)."""
    texts = {c: missing_to_null(F.col(c)) for c in RAW_COLUMNS}
    typed = {
        "event_time": parse_event_time(texts["event_time"]),
        "event_type": texts["event_type"],
        "product_id": texts["product_id"].try_cast("bigint"),
        "category_id": texts["category_id"].try_cast("bigint"),
        "category_code": texts["category_code"],
        "brand": texts["brand"],
        "price": texts["price"].try_cast("float"),
        "user_id": texts["user_id"].try_cast("bigint"),
        "user_session": texts["user_session"],
    }
    reason = F.when(F.col(CORRUPT_COLUMN).isNotNull(), F.lit("malformed row"))
    for c in RAW_COLUMNS:
        reason = reason.when(texts[c].isNotNull() & typed[c].isNull(), F.lit(f"bad {c}"))
        if c in REQUIRED:
            reason = reason.when(texts[c].isNull(), F.lit(f"missing {c}"))
    return df.select(
        *[typed[c].alias(c) for c in RAW_COLUMNS],
        reason.alias(REASON_COLUMN),
        F.when(reason.isNotNull(), F.to_json(F.struct(*RAW_COLUMNS))).alias("raw_row"),
        SOURCE_COLUMN,
        "ordinal",
    )


def csv_entries(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """The ``*.csv`` files of a flat folder, and what else goes by such a name."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(folder, "*.csv")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    named = [f for f in found if f.getPath().getName()[0] not in "._"]
    files = [f.getPath().toString() for f in named if f.isFile()]
    return files, [f.getPath().toString() for f in named if not f.isFile()]


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    return csv_entries(spark, folder)[0]


def plain_path(spark: SparkSession, uri: str) -> str:
    """A ``source_file`` as a path to read."""
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString()


def source_name(spark: SparkSession, path: str) -> str:
    """A path as a ``source_file``."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()


def file_inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Per file that is not empty: its first line, and how many lines leave a quote open.

    Tasks read the lines as they are; a doubled quote inside a field counts twice and
    so changes nothing.
    """
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias(SOURCE_COLUMN), place.alias("place"), "value", quotes.alias("quotes")
    )
    return lines.groupBy(SOURCE_COLUMN).agg(
        F.min_by("value", "place").alias("header"), F.count_if(F.col("quotes") % 2 == 1).alias("open_lines")
    )


def _names_in(header: str) -> tuple[str, ...]:
    names = next(csv.reader([header.removeprefix("\ufeff")]), [])
    return tuple(name.strip() for name in names)


def _is_events(file: Row) -> bool:
    return not set(RAW_COLUMNS).isdisjoint(_names_in(file["header"]))


def _read_alike(spark: SparkSession, header: tuple[str, ...], multi_line: bool, paths: list[str]) -> DataFrame:
    """Raw columns of files that share a header; those it lacks are null.

    Other columns, and a name's second column, are parsed and left out.
    """
    names = [
        name if name in RAW_COLUMNS and name not in header[:i] else f"_other{i}"
        for i, name in enumerate(header)
    ]
    fields = [T.StructField(n, T.StringType()) for n in [*names, CORRUPT_COLUMN]]
    raw = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .csv(paths)
    )
    missing = F.lit(None).cast("string")
    return raw.select(
        *[(F.col(c) if c in names else missing).alias(c) for c in RAW_COLUMNS],
        CORRUPT_COLUMN,
        F.col("_metadata.file_path").alias(SOURCE_COLUMN),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def read_inventoried(spark: SparkSession, files: Iterable[Row]) -> DataFrame:
    """Untyped rows of the files of an inventory with their file and block, columns by header name.

    Files with the same header are one scan. Where open quotes come in pairs of lines, fields
    hold line breaks and a file is read as a whole; a quote that is never closed spoils its line only.
    """
    alike: dict[tuple, list[str]] = {}
    for file in files:
        multi_line = file["open_lines"] > 0 and file["open_lines"] % 2 == 0
        path = plain_path(spark, file[SOURCE_COLUMN])
        alike.setdefault((_names_in(file["header"]), multi_line), []).append(path)
    scans = [_read_alike(spark, *kind, found) for kind, found in sorted(alike.items())]
    if scans:
        return reduce(DataFrame.unionByName, scans)
    texts = [T.StructField(c, T.StringType()) for c in [*RAW_COLUMNS, CORRUPT_COLUMN, SOURCE_COLUMN]]
    return spark.createDataFrame([], T.StructType([*texts, T.StructField("_block", T.LongType())]))


def read_raw(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    paths = list(paths)
    return read_inventoried(spark, filter(_is_events, file_inventory(spark, paths).collect()) if paths else [])


def type_raw_rows(raw: DataFrame) -> DataFrame:
    """Typed rows with their place in the file, bad ones marked in ``reject_reason``.

    Within a task the id grows in the order of the file's lines, and the block
    orders the parts of a file that were read by different tasks.
    """
    place = F.struct(F.col("_block").alias("block"), F.monotonically_increasing_id().alias("row"))
    return _typed(raw.withColumn("ordinal", place))


def scan_events_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.csv`` of a flat folder, typed, bad rows marked in ``reject_reason``."""
    return type_raw_rows(read_raw(spark, csv_files(spark, folder)))


def land_scanned(spark: SparkSession, paths: Iterable[str]) -> tuple[DataFrame, list[tuple[str, str | None]]]:
    """Typed rows of some files as written, and per file why it could not be read, null for most.

    Where a read fails, its files are tried again in halves, so the ones that fail are found
    and all others are taken in whole. A file counts with all its rows or with none.
    """
    landed: list[DataFrame] = []
    files: list[tuple[str, str | None]] = []
    waiting = [list(paths)] if paths else []
    while waiting:
        some = waiting.pop()
        try:
            inventory = file_inventory(spark, some).collect()
            events = list(filter(_is_events, inventory))
            if events:
                landed.append(materialize(type_raw_rows(read_inventoried(spark, events)), "scanned"))
        except (PySparkException, Py4JJavaError) as error:
            half = len(some) // 2
            if half:
                waiting += [some[:half], some[half:]]
            else:
                files.append((source_name(spark, some[0]), _reason(error)))
            continue
        files += [(file[SOURCE_COLUMN], None if file in events else "no known column") for file in inventory]
        known = {plain_path(spark, file[SOURCE_COLUMN]) for file in inventory}
        files += [(source_name(spark, path), "empty file") for path in some if path not in known]
    if not landed:
        landed = [type_raw_rows(read_inventoried(spark, []))]
    return reduce(DataFrame.unionByName, landed), files


def _reason(error: Exception) -> str:
    """The innermost cause that the message of a failed job names."""
    text = str(error)
    causes = re.findall(r"Caused by: (.+)", text)
    return (causes[-1] if causes else text.strip().splitlines()[0])[:300]


def accepted_rows(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col(REASON_COLUMN).isNull()).drop(REASON_COLUMN, "raw_row")


def rejected_rows(scanned: DataFrame) -> DataFrame:
    """The quarantine table: file, reason and the row as it was read."""
    return scanned.where(F.col(REASON_COLUMN).isNotNull()).select(SOURCE_COLUMN, REASON_COLUMN, "raw_row")


def clean_scanned(scanned: DataFrame, scope: str = "file") -> DataFrame:
    """Cleaned events of a scan with their ``source_file``.

    ``scope="file"`` removes copies within each file, ``"global"`` across all;
    the first copy is then the one in the first file by name.
    """
    rows = accepted_rows(scanned)
    if scope == "file":
        return clean_events(rows, "ordinal", scope=[SOURCE_COLUMN])
    if scope == "global":
        return clean_events(rows, F.struct(SOURCE_COLUMN, "ordinal"))
    raise ValueError(f"scope must be 'file' or 'global', not {scope!r}")


def ingest_folder(spark: SparkSession, folder: str, scope: str = "file") -> DataFrame:
    """Rows of the events table from the readable CSV files of a folder."""
    scanned, _ = land_scanned(spark, csv_files(spark, folder))
    return clean_scanned(scanned, scope).select(*EVENTS_SCHEMA.names)


def ingest_report(
    scanned: DataFrame,
    scope: str = "file",
    inserted: DataFrame | None = None,
    files: list[tuple[str, str | None]] | None = None,
) -> DataFrame:
    """Per file: rows read, rejected, with a path deeper than the table, inserted, and its failure if any.

    ``inserted`` holds the events taken in with their ``source_file``; without it they are
    cleaned for the count. ``files`` names files without rows too.
    """
    spark = scanned.sparkSession
    depth = category_depth(normalise_text(F.col("category_code")))
    counts = scanned.groupBy(SOURCE_COLUMN).agg(
        F.count("*").alias("rows_read"),
        F.count_if(F.col(REASON_COLUMN).isNotNull()).alias("rows_rejected"),
        F.count_if(F.col(REASON_COLUMN).isNull() & (depth > CATEGORY_LEVELS)).alias("rows_too_deep"),
    )
    if files is None:
        counts = counts.withColumn("failure", F.lit(None).cast("string"))
    else:
        listed = spark.createDataFrame(files, f"{SOURCE_COLUMN} string, failure string")
        counts = listed.join(counts, SOURCE_COLUMN, "left")
    taken = (clean_scanned(scanned, scope) if inserted is None else inserted).groupBy(SOURCE_COLUMN)
    names = ["rows_read", "rows_rejected", "rows_too_deep", "rows_inserted"]
    found = counts.join(taken.agg(F.count("*").alias("rows_inserted")), SOURCE_COLUMN, "left")
    return found.fillna(0, subset=names).select(SOURCE_COLUMN, *names, "failure")
