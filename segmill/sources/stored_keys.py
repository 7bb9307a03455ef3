"""Which events the table already holds: Bloom filters per month and batch, then the events.

Every batch keeps, beside the events, a filter of their keys: 64-bit words, each with the
bits of the keys that fall on it (``KEYS_PER_WORD`` on average, ``PROBES`` bits each). New
events ask the words of their months. Most are in none of them and are new; for the rest,
about one in thirty of the new ones and all that are stored, the stored keys of these
months and times decide. So a batch costs a look at words of its months, about a twentieth
of the stored keys, and the stored events themselves are shuffled only against the doubtful.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.functions.scalars import month_of
from segmill.operators.cleaning import DEDUP_KEYS
from segmill.session import materialize
from segmill.sources.tables import BATCH_COLUMN, BATCHED_EVENTS_SCHEMA, MONTH_COLUMN, replace_batch

KEYS_PER_WORD = 4
PROBES = 6

KEYS_SCHEMA = f"width int, word long, bits long, {BATCH_COLUMN} int, {MONTH_COLUMN} string"
_HASH = "_key_hash"


def keys_path(events: str) -> str:
    return f"{events.rstrip('/')}_keys"


def _bits() -> Column:
    """The bits of a key in its word, from the low end of its hash."""
    one = F.lit(1).cast("long")
    places = [F.shiftrightunsigned(_HASH, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(PROBES)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", one, place) for place in places])


def _word(width: Column) -> Column:
    """The word of a key among 2**width, from the high end of its hash."""
    shifted = F.call_function("shiftrightunsigned", F.col(_HASH), (64 - width).cast("int"))
    return F.when(width == 0, F.lit(0).cast("long")).otherwise(shifted)


def _hashed(events: DataFrame) -> DataFrame:
    return events.withColumn(_HASH, F.xxhash64(*DEDUP_KEYS))


def write_keys(new: DataFrame, n_rows: int, events: str, batch: int) -> None:
    """The filters of a batch of ``n_rows`` events, which take the place of its former ones."""
    width = max(0, ceil(log2(max(1, n_rows) / KEYS_PER_WORD)))
    words = (
        _hashed(new.select(*DEDUP_KEYS))
        .groupBy(month_of(F.col("event_time")).alias(MONTH_COLUMN), _word(F.lit(width)).alias("word"))
        .agg(F.bit_or(_bits()).alias("bits"))
    )
    columns = [F.lit(width).alias("width"), "word", "bits", MONTH_COLUMN]
    replace_batch(words.select(*columns), keys_path(events), batch, MONTH_COLUMN)


def batches_at(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the batches that a table has directories of."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path, f"{BATCH_COLUMN}=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return {int(f.getPath().getName().split("=")[1]) for f in found}


def stored_keys(spark: SparkSession, events: str, months: list[str], batches: set[int]) -> DataFrame:
    """Keys of the stored events of some months and batches; no other directory is read."""
    rows = spark.read.schema(BATCHED_EVENTS_SCHEMA).parquet(events)
    chosen = F.col(MONTH_COLUMN).isin(months) & F.col(BATCH_COLUMN).isin(sorted(batches))
    return rows.where(chosen).select(*DEDUP_KEYS)


def _maybe_stored(spark: SparkSession, new: DataFrame, events: str, months: list[str], batches: set[int]) -> DataFrame:
    """Hashes of new events that a filter of an earlier batch may hold."""
    words = (
        spark.read.schema(KEYS_SCHEMA)
        .parquet(keys_path(events))
        .where(F.col(MONTH_COLUMN).isin(months) & F.col(BATCH_COLUMN).isin(sorted(batches)))
    )
    widths = sorted(row[0] for row in words.select("width").distinct().collect())
    if not widths:
        return new.select(_HASH).limit(0)
    asked = new.select(MONTH_COLUMN, _HASH, F.explode(F.array(*map(F.lit, widths))).alias("width")).withColumn(
        "word", _word(F.col("width"))
    )
    met = asked.join(words.select(MONTH_COLUMN, "width", "word", "bits"), [MONTH_COLUMN, "width", "word"])
    return met.where(F.col("bits").bitwiseAND(_bits()) == _bits()).select(_HASH).distinct()


def not_stored(new: DataFrame, events: str, before: int) -> DataFrame:
    """Those of the ``new`` events that no batch before the given number has stored.

    Batches without a filter, as of tables from before there were any, are asked directly.
    """
    spark = new.sparkSession
    earlier = {b for b in batches_at(spark, events) if b < before}
    months = [row[0] for row in new.select(month_of(F.col("event_time"))).distinct().collect()]
    if not earlier or not months:
        return new
    hashed = _hashed(new).withColumn(MONTH_COLUMN, month_of(F.col("event_time")))
    filtered = earlier & batches_at(spark, keys_path(events))
    doubt = F.lit(True) if earlier - filtered else F.coalesce("maybe", F.lit(False))
    if filtered:
        maybe = _maybe_stored(spark, hashed, events, months, filtered).withColumn("maybe", F.lit(True))
        hashed = hashed.join(maybe, _HASH, "left")
    marked = materialize(hashed.withColumn("doubt", doubt), "marked")
    micros = F.unix_micros(F.col("event_time"))
    first, last = marked.where("doubt").agg(F.min(micros), F.max(micros)).first()
    if first is None:
        return marked.select(*new.columns)
    start, end = F.timestamp_micros(F.lit(first)), F.timestamp_micros(F.lit(last))
    known = stored_keys(spark, events, months, earlier).where(F.col("event_time").between(start, end))
    unknown = marked.where("doubt").join(known, DEDUP_KEYS, "left_anti")
    return marked.where("not doubt").unionByName(unknown).select(*new.columns)
