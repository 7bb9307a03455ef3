"""Quality ledger, SimHash, mixing and chat formatting on hand-made tables."""

from __future__ import annotations

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from segmill.llm import chat, mixing, quality, simhash
from segmill.llm.components import connected_components

DOCS = "doc_id long, text string, source string, n_chars long, key long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))
    long_text = " ".join(word() for _ in range(3000))
    rows = [
        (1, None, "a", None, 0),
        (2, "", "a", 0, 0),
        (3, " \t\n\x0b\x0c\r", None, 6, 0),
        (4, long_text, "b", len(long_text), 1),
        (4, long_text, "b", len(long_text), 1),
        (5, long_text + " tail", "b", len(long_text) + 5, 1),
        (None, "one two one two one two\none two one two one two", None, 47, 2),
        (6, "a#b $c é%&", "c", 10, 3),
        (7, "x y z", "c", 5, 3),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(covered)


def test_ledger_measures(docs):
    short = docs.where("doc_id is null or doc_id not in (4, 5)")
    texts = {r.doc_id: r.text or "" for r in short.collect()}
    for row in quality.ledger(short).collect():
        text = texts[row.doc_id]
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert row.n_words == len(words)
        assert row.word_chars == sum(len(w.decode()) for w in words)
        assert row.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert row.n_dup_lines == len(lines) - len(set(lines))
        assert row.n_repeat_words == brute_repeats(words)
        assert row.failed & 1  # all are short


def test_policies_and_ablation(docs, empty):
    rows = quality.ledger(docs)
    n_kept = rows.where(quality.passes("v1")).count()
    assert n_kept == 3
    costs = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(rows, "v1").collect()}
    assert costs["few_words"][0] == 6
    assert quality.ledger(empty).count() == 0
    assert quality.filter_documents(empty).columns == docs.columns


def test_filter_keeps_columns_and_repeated_rows(docs):
    kept = quality.filter_documents(docs.withColumnRenamed("key", "failed"))
    assert kept.columns == ["doc_id", "text", "source", "n_chars", "failed"]
    assert sorted(r.doc_id for r in kept.collect()) == [4, 4, 5]


def brute_simhash(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs):
    prints = simhash.fingerprints(docs).collect()
    wanted = sorted(brute_simhash(r.text, 4) for r in docs.collect())
    assert sorted(r.fingerprint % (1 << 64) for r in prints) == wanted


def test_links_connect_what_brute_force_does(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            flipped = base
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                flipped ^= 1 << bit
            prints.add(flipped)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                one, two = sorted((find(signed[i]), find(signed[j])))
                root[two] = one
    # small shards, so that large blocks are split as well
    for shard in (4096, 2):
        found = connected_components(simhash.links(nodes, 4, shard)).collect()
        got = {r.node: r.root for r in found}
        assert {p: find(p) for p in signed} == {p: got.get(p, p) for p in signed}


def test_classes_and_keep_one(docs, empty):
    classes = {(r.doc_id, r.component_id) for r in simhash.classes(simhash.fingerprints(docs)).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)} <= classes
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 7]
    assert simhash.classes(simhash.fingerprints(empty)).count() == 0


def test_mix_reaches_targets(spark, docs, empty):
    rng = random.Random(5)
    rows = [
        (i, " ".join("w" for _ in range(rng.choice([0, 3, 40, 900]))), rng.choice(["a", "b", "é", None]), 0, 0)
        for i in range(400)
    ]
    frame = spark.createDataFrame(rows, DOCS)
    got = mixing.taken(frame)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.taken(frame).collect()))
    total = sum(len(r[1].split()) for r in rows)
    by_source = {}
    for r in got.collect():
        assert 0 <= r.taken <= 3 * r.size
        size, taken = by_source.get(r.source, (0, 0))
        by_source[r.source] = (size + r.size, taken + r.taken)
        by_source[r.source, "target"] = r.target
    weights = dict(zip(["a", "b", "é", None], [1, 2, 3, 1]))
    for source, weight in weights.items():
        size, taken = by_source[source]
        assert by_source[source, "target"] == pytest.approx(min(3 * size, total * weight / 7))
        assert abs(taken - by_source[source, "target"]) <= 1
    assert mixing.taken(docs).count() == docs.count()
    assert mixing.taken(empty).count() == 0


def test_targets_stop_at_three_times_their_source(spark):
    sized = spark.createDataFrame(
        [(1, "a", 1000), (2, "b", 10), (3, "c", 20), (4, "d", 0)], "doc_id long, source string, size long"
    )
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    assert got["b"] == 30 and got["c"] == 60 and got["d"] == 0
    assert got["a"] == pytest.approx(1030 - 90)


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 7, 100, 1009):
        frame = spark.range(n).select(
            mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(42)).alias("p")
        )
        assert sorted(r.p for r in frame.collect()) == list(range(n))


def test_mixed_documents_keep_columns(docs, empty):
    got = mixing.mixed_documents(docs, block_words=64)
    assert got.columns == docs.columns
    assert all(r.text and len(r.text) == r.n_chars for r in got.collect() if r.doc_id in (4, 5))
    assert mixing.mixed_documents(empty).count() == 0


EVENTS = "conv_id long, message long, seq long, kind string, role string, text string, extra int"


def test_fold_of_an_event_log(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 0, "message", "assistant", ""),
        (1, 1, 1, "delta", None, "wro"),
        (1, 1, 2, "delta", None, "ng"),
        (1, 1, 3, "regenerate", None, None),
        (1, 1, 4, "delta", None, "rig"),
        (1, 1, 5, "delta", None, "ht <|im_end|>"),
        (1, 0, 9, "edit", None, "hello"),
        (None, 0, 0, "message", None, None),
    ]
    random.Random(2).shuffle(log)
    events = spark.createDataFrame([(*e, 0) for e in log], EVENTS)
    turns = chat.format_messages(events).collect()
    texts = {(r.conv_id, r.turn): list(chat.read_back(r.formatted)) for r in turns}
    assert texts == {
        (1, 0): [("user", "hello")],
        (1, 1): [("assistant", "right <|im_end|>")],
        (None, 0): [("", "")],
    }
    spans = {(r.conv_id, r.turn): [r.formatted[a:b] for a, b in r.loss_spans] for r in turns}
    assert [chat.unescape(s) for s in spans[1, 1]] == ["right <|im_end|>"]
    assert chat.digests(events.limit(0)).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(4)
    parts = ["<", "|", "\\", "im_end", "|>", "\n", "n", chat.START, chat.END, "é"]
    for _ in range(3000):
        turns = [
            tuple("".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(2)) for _ in range(3)
        ]
        formatted = "".join(chat.render(*turn)[0] for turn in turns)
        assert list(chat.read_back(formatted)) == turns


def test_digest_of_repeated_and_null_turns(spark):
    rows = [(5, 0, "user", None), (5, 1, "assistant", "a"), (5, 1, "assistant", "a"), (5, None, None, "z")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = chat.digests(chat.as_events(conversations)).collect()
    turns = "\nz\nuser\n\nassistant\na\nassistant\na\n"
    assert (row.n_turns, row.loss_chars) == (4, 2)
    assert row.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(b"aa").hexdigest()
