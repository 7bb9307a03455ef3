"""Quality rules as a ledger: every rule runs once, its outcome is one bit of a mask.

``ledger`` measures each text and stores the failure bits beside the measurements.
Policies are masks over those bits, so another version of a policy, or the
question what a single rule costs, is answered from the ledger without reading a
text again. Everything is built from DataFrame functions.

A null text counts as empty: no words, and the rule on short texts fails. Texts
without lines, symbols or repeated windows measure 0. Repeated rows are judged one
by one; other columns, of whatever name, are left out of the ledger. An empty
table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the measurements.
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"



def rules() -> list[tuple[str, Column]]:
    """Rules in bit order; the position of a rule in this list is its bit."""
    c = F.col
    return [
        ("few_words", c("n_words") < 50),
        ("repeated_words", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > c("n_words")),
        ("repeated_lines", 2 * c("n_dup_lines") > c("n_lines")),
        ("exclamation", 10 * c("n_bangs") > 3 * c("n_words")),
        ("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 12 * c("n_words"))),
    ]


#: Versioned policies: the names of the rules that count.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": (
        "few_words",
        "repeated_words",
        "symbols",
        "repeated_lines",
        "exclamation",
        "word_length",
    ),
}


def mask(policy: str) -> int:
    names = [name for name, _ in rules()]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space."""
    for space in SPACES[:-1]:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _count(text: Column, characters: str) -> Column:
    """How often some ASCII characters occur, by the bytes that go with them."""
    counts = [
        F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters
    ]
    return sum(counts[1:], counts[0]).cast("long")


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and measurements of every text.

    Windows of three words are compared by their 64-bit hash. Sorting them with
    their positions keeps a text of any length at n log n; the sort is skipped
    where no hash occurs twice.
    """
    c = F.col
    lines = F.filter(F.split(c("_text"), "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    texts = docs.select(
        c(id_column).alias("_id"), F.coalesce(c(text_column), F.lit("")).alias("_text")
    )
    counted = texts.select(
        "_id",
        words(c("_text")).alias("_words"),
        lines.alias("_lines"),
        _count(c("_text"), SYMBOLS).alias("n_symbols"),
        _count(c("_text"), "!").alias("n_bangs"),
    )
    measured = ["n_symbols", "n_bangs"]
    hashed = counted.select(
        "_id",
        *measured,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice(c("_words"), F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
            lambda word, i: F.xxhash64(word, F.get(c("_words"), i + 1), F.get(c("_words"), i + 2)),
        ).alias("_windows"),
    )
    measured += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    ordered = hashed.select(
        "_id",
        *measured,
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(
                F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ).alias("_ordered"),
    )
    twice = F.filter(
        "_ordered",
        lambda x, i: (F.get(c("_ordered"), i - 1)["h"] == x["h"])
        | (F.get(c("_ordered"), i + 1)["h"] == x["h"]),
    )
    starts = ordered.select(
        "_id",
        *measured,
        F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_starts"),
    )
    # a repeated window covers its three words up to the start of the next one
    covered = F.transform(
        "_starts",
        lambda x, i: F.least(F.coalesce(F.get(c("_starts"), i + 1) - x, F.lit(3)), F.lit(3)),
    )
    return starts.select(
        c("_id").alias(id_column),
        *measured,
        F.coalesce(
            F.aggregate(covered, F.lit(0).cast("long"), lambda total, x: total + x), F.lit(0)
        )
        .cast("long")
        .alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements and ``failed``, the mask of the rules that a text fails."""
    measured = measure(docs, id_column, text_column)
    bits = [
        F.when(failing, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
        for bit, (_, failing) in enumerate(rules())
    ]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def passes(policy: str) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy costs: texts it fails, and texts that it alone fails.

    The ledger is first counted by mask, so at most 2 ** rules rows are unfolded.
    """
    names = [name for name, _ in rules()]
    relevant = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long"))
    by_mask = rows.groupBy(relevant.alias("failed")).agg(F.count("*").alias("n"))
    bits = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(1 << names.index(rule)).cast("long").alias("bit"))
            for rule in POLICIES[policy]
        ]
    )
    unfolded = by_mask.select("failed", "n", F.explode(bits).alias("r")).select("failed", "n", "r.*")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return unfolded.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def filter_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that pass a policy, all columns kept.

    The verdict is taken from the text itself beside the row, so no key is needed
    and repeated rows or null ids keep their own verdict.
    """
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col("text").alias("_judged")
    )
    judged = ledger(packed, "_row", "_judged")
    # a filter would be moved below the measurements and repeat them; not past a row number
    numbered = judged.withColumn("_number", F.monotonically_increasing_id())
    passing = numbered.where(passes(policy) & (F.col("_number") >= 0))
    return passing.select(*[F.col("_row")[n].alias(n) for n in names])
