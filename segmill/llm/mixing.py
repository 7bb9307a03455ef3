"""Mix sources to target weights, from blocks of fixed length.

The words of a source form one stream, cut into blocks of ``block_words``. The mix
is a table of slots in output shards. Every shard draws from which sources its
slots come (a multinomial draw over the sources' shares); the n-th slot of a source
takes the block that a pseudorandom permutation of the source's block numbers puts
at place n, a new permutation for each pass over the source. Slots and documents
then meet on (source, block).

A document is a row; repeated rows and ids are documents of their own. A null text
has size 0, as an empty one; such documents get nothing. A null source is a source,
ordered last. A table without words gives targets of 0 and no slots.

Only DataFrame functions run here. What grows with the corpus is spread by
(source, bucket) or (source, block), so a source with most of the rows is not one
task; tables with one row per source are left to the planner to broadcast or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.llm.quality import words
from segmill.session import materialize

BLOCK_WORDS = 256
SHARD_SLOTS = 4096
TASK_SLOTS = 1 << 16
BUCKET_DOCS = 20_000
MAX_PASSES = 3
CYCLE = (1, 2, 3)
ROUNDS = 4
LOOKUP = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of every document."""
    return docs.select(
        "doc_id",
        "source",
        F.size(words(F.coalesce("text", F.lit("")))).cast("long").alias("size"),
    )


def targets(sized: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """One row per source: its number, size and target.

    Weights repeat ``cycle`` over the sources in order. Targets share the size of
    the whole table by weight, but stop at ``MAX_PASSES`` times their source; what
    that leaves over goes to the others by weight. Ordered by the share at which
    they stop, the stopped sources come first, so running sums find the level.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), rank % len(cycle) + 1)
    everything = Window.partitionBy()
    by_stop = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_stop.rowsBetween(0, Window.unboundedFollowing)
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("sid", rank)
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(float(MAX_PASSES)) * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("taken_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("taken_before")) / F.sum("weight").over(onwards))
        .withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn(
            "level",
            F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(
                by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        )
        .select(
            "sid",
            "source",
            "source_size",
            F.when(F.col("stops"), F.col("cap"))
            .otherwise(F.col("level") * F.col("weight"))
            .alias("target"),
        )
    )


def quotas(target: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks, whole passes, words of the last pass and number of slots of every source."""
    size = F.col("source_size")
    return (
        target.withColumn("full_blocks", F.floor(size / block_words).cast("long"))
        .withColumn("blocks", F.ceil(size / block_words).cast("long"))
        .withColumn(
            "passes", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
        )
        .withColumn("rest", F.round(F.col("target") - F.col("passes") * size).cast("long"))
        .withColumn(
            "quota",
            F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block_words).cast("long"),
        )
        .withColumn(
            "first_slot",
            F.coalesce(
                F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
    )


def permuted(place: Column, n: Column, *key: Column) -> Column:
    """Pseudorandom permutation of 0 .. n - 1.

    Places are pairs over a grid of a rows and b columns that just holds n; rounds
    add a hash of one part to the other, which is one-to-one on the grid. A result
    beyond n (there are fewer than a) is permuted again.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    b = F.ceil(n / a).cast("long")

    def once(x: Column) -> Column:
        pair = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
        steps = F.array(*[F.lit(i) for i in range(ROUNDS)])

        def step(p: Column, i: Column) -> Column:
            left = (p["l"] + F.pmod(F.xxhash64(*key, i, p["r"]), a)) % a
            right = (p["r"] + F.pmod(F.xxhash64(*key, i + ROUNDS, left), b)) % b
            return F.struct(left.alias("l"), right.alias("r"))

        end = F.aggregate(steps, pair, step)
        return end["l"] * b + end["r"]

    walk = F.sequence(F.lit(1), F.lit(32))
    return F.aggregate(walk, once(place), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def slots(
    sources: DataFrame, seed: int = 42, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS
) -> DataFrame:
    """The mix: (shard, sid, rank, block, pass, take), the words a slot takes of its block.

    Shards draw with replacement, so a source is drawn a little more or less often
    than its quota in all. Draws beyond the quota are void, and closing shards hold
    what is missing; the words taken of a source are its target, rounded.
    """
    spark = sources.sparkSession
    n_slots = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).cast("long")).first()[0]
    n_shards = -(-n_slots // shard_slots)
    width = max(1, -(-n_slots // LOOKUP))
    draws = (
        spark.range(n_slots)
        .withColumn("shard", F.floor(F.col("id") / shard_slots).cast("long"))
        .withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "shard", "id"), F.lit(max(1, n_slots))))
        .withColumn("cell", F.floor(F.col("draw") / width).cast("long"))
    )
    # a source owns the draws first_slot .. first_slot + quota - 1, looked up by cell
    owners = sources.where("quota > 0").select(
        "sid",
        "first_slot",
        "quota",
        F.explode(
            F.sequence(
                F.floor(F.col("first_slot") / width), F.floor((F.col("first_slot") + F.col("quota") - 1) / width)
            )
        ).alias("cell"),
    )
    counts = (
        draws.join(owners, "cell")
        .where((F.col("draw") >= F.col("first_slot")) & (F.col("draw") < F.col("first_slot") + F.col("quota")))
        .groupBy("shard", "sid", "quota")
        .agg(F.count("*").alias("n"))
    )
    counts = materialize(counts, "draws")
    upto = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = (
        counts.withColumn("from", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        .withColumn("to", F.least(F.col("from") + F.col("n"), "quota"))
        .where("`from` < `to`")
        .select("shard", "sid", "from", "to")
    )
    missing = (
        sources.where("quota > 0")
        .select("sid", "quota")
        .join(counts.groupBy("sid").agg(F.sum("n").alias("had")), "sid", "left")
        .withColumn("had", F.coalesce("had", F.lit(0)))
        .where("had < quota")
        .select("sid", "quota", F.explode(F.expr(f"sequence(had, quota - 1, {shard_slots})")).alias("from"))
        .select(
            (F.lit(n_shards) + F.floor(F.col("from") / shard_slots)).cast("long").alias("shard"),
            "sid",
            "from",
            F.least(F.col("from") + shard_slots, "quota").alias("to"),
        )
    )
    # runs of slots are short rows of few files: spread them before they become slots
    tasks = max(1, -(-n_slots // TASK_SLOTS))
    spread = drawn.unionByName(missing).repartition(tasks, "shard", "sid", "from")
    ranked = spread.select(
        "shard", "sid", F.explode(F.expr("sequence(`from`, `to` - 1)")).alias("rank")
    )
    keyed = ranked.join(sources, "sid")
    run = F.floor(F.col("rank") / F.col("blocks")).cast("long")
    place = F.col("rank") % F.col("blocks")
    # the short block at the end of a stream keeps its place, so place * block_words words come before
    block = F.when(
        place < F.col("full_blocks"),
        permuted(place, F.col("full_blocks"), F.lit(seed), F.col("sid"), run),
    ).otherwise(place)
    held = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    return (
        keyed.withColumn("run", run)
        .withColumn("place", place)
        .withColumn("block", block)
        .withColumn(
            "take",
            F.when(F.col("run") < F.col("passes"), held).otherwise(
                F.least(held, F.col("rest") - F.col("place") * block_words)
            ),
        )
        .select("shard", "sid", "rank", "run", "block", "take")
    )


def streams(sized: DataFrame, target: DataFrame, seed: int = 42) -> DataFrame:
    """Every document with its source's numbers and ``start``, its place in the stream.

    Streams are ordered by a hash bucket of the id, then id: sums of buckets give
    the offsets, so no source is ever ordered in one task.
    """
    n = sized.count()
    buckets = max(1, -(-n // BUCKET_DOCS))
    keyed = sized.withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(buckets))
    )
    joined = keyed.join(
        target.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    in_bucket = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size")
    placed = joined.withColumn("nth", F.row_number().over(in_bucket)).withColumn(
        "start",
        F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    )
    upto = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        joined.groupBy("sid", "bucket")
        .agg(F.sum("size").alias("held"))
        .select("sid", "bucket", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("offset"))
    )
    return placed.join(offsets, ["sid", "bucket"]).withColumn(
        "start", F.col("start") + F.col("offset")
    ).drop("offset")


def pieces(placed: DataFrame, mix: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What each slot takes of each document: word range [lo, hi) in the document, by pass."""
    spans = (
        placed.where("size > 0")
        .select(
            "sid",
            "bucket",
            "nth",
            "start",
            "size",
            F.explode(
                F.sequence(
                    F.floor(F.col("start") / block_words),
                    F.floor((F.col("start") + F.col("size") - 1) / block_words),
                )
            ).alias("block"),
        )
    )
    first = F.col("block") * block_words
    lo = F.greatest(F.col("start"), first)
    hi = F.least(F.col("start") + F.col("size"), first + F.col("take"))
    return (
        spans.join(mix.select("sid", "block", "run", "take"), ["sid", "block"])
        .where(hi > lo)
        .select(
            "sid",
            "bucket",
            "nth",
            "run",
            (lo - F.col("start")).alias("lo"),
            (hi - F.col("start")).alias("hi"),
        )
    )


def taken(docs: DataFrame, seed: int = 42, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target and the words the mix takes of each document."""
    sized = materialize(sizes(docs), "sizes")
    target = materialize(targets(sized), "targets")
    placed = materialize(streams(sized, target, seed), "streams")
    mix = slots(quotas(target, block_words), seed, block_words)
    words_taken = (
        pieces(placed, mix, block_words)
        .groupBy("sid", "bucket", "nth")
        .agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    )
    return placed.join(words_taken, ["sid", "bucket", "nth"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: int = 42, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    A pass that takes a document whole gives the row as it is. A pass that takes
    parts of it gives one row with the words of these parts in order, one space
    between them, and n_chars counted anew. Documents that no slot takes go.
    """
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"),
        F.col("doc_id"),
        F.col("source"),
        F.xxhash64(text).alias("_digest"),
        F.size(words(text)).cast("long").alias("size"),
    )
    narrow = materialize(whole.drop("_row"), "sizes")
    target = materialize(targets(narrow), "targets")
    # repeated rows share id and text; they are told apart by number only, which any of them may take
    placed = materialize(streams(narrow, target, seed), "streams")
    mix = slots(quotas(target, block_words), seed, block_words)
    parts = (
        pieces(placed, mix, block_words)
        .groupBy("sid", "bucket", "nth", "run")
        .agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("parts"))
        .join(placed.select("sid", "bucket", "nth", "doc_id", "_digest"), ["sid", "bucket", "nth"])
    )
    runs = parts.groupBy("doc_id", "_digest").agg(F.collect_list("parts").alias("runs"))
    picked = (
        whole.dropDuplicates(["doc_id", "_digest"])
        .alias("d")
        .join(
            runs.alias("r"),
            F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d._digest") == F.col("r._digest")),
        )
        .select("d._row", "d.size", F.explode("r.runs").alias("parts"))
    )
    in_parts = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"])
    cut = F.array_join(
        F.flatten(
            F.transform(
                "parts",
                lambda p: F.slice(words(F.col("_row")["text"]), (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")),
            )
        ),
        " ",
    )
    complete = in_parts == F.col("size")
    rows = picked.withColumn("_whole", complete).withColumn(
        "_text", F.when(complete, F.col("_row")["text"]).otherwise(cut)
    )
    changed = {
        "text": F.col("_text"),
        "n_chars": F.when(F.col("_whole"), F.col("_row")["n_chars"]).otherwise(
            F.length("_text").cast("long")
        )
        if "n_chars" in names
        else None,
    }
    return rows.select(
        *[
            changed[n].alias(n) if changed.get(n) is not None else F.col("_row")[n].alias(n)
            for n in names
        ]
    )
