"""Lexical search, hard negatives and token counts against plain Python and the public library."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from segmill.llm import hard_negatives, lexical_search, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def brute_search(docs, items, k=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c in counted:
            m = 100 - 25 + (25 * c.total() * n_docs) // n_terms
            score = sum(
                times
                * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in wanted.items()
                if t in c
            )
            if score > 0:
                found.append((-score, math.inf if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: f[:2])[:k], 1)]
    return sorted(out, key=repr)


def of_search(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    common = [f"w{i}" for i in range(30)]
    rare = [f"Üñ{i}" for i in range(400)]
    docs = [(None, "w1 w2"), (None, "W1,w2"), (3, None), (4, ""), (5, " -- !"), (6, "x" * 5000 + " w3")]
    for i in range(10, 400):
        words = [rng.choice(common if rng.random() < 0.8 else rare) for _ in range(rng.choice([1, 5, 40, 400]))]
        docs.append((i, rng.choice([" ", "-", "\n"]).join(words)))
    docs += [(i + 1000, t) for i, t in docs if i and i > 380] + docs[-3:]
    items = [(i, " ".join(rng.choice(common + rare[:20]) for _ in range(rng.randint(1, 40)))) for i in range(30)]
    items += [(90, None), (91, "..."), (92, "unheard"), (93, "w1 W1 w1"), (93, "w2"), (None, "w5 w6")]
    return docs, items


@pytest.mark.parametrize(
    "shard_terms, terms_broadcast, k", [(2_000_000, 200_000, 20), (300, 200_000, 20), (900, 0, 5), (1, 0, 20)]
)
def test_search_equals_brute_force(spark, corpus, shard_terms, terms_broadcast, k):
    docs, items = corpus
    # other columns may have any name
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, term int, shard int")
    queries = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, block int")
    index = lexical_search.build_index(frame.repartition(3), shard_terms)
    got = lexical_search.search(index, queries, k, terms_broadcast)
    # a null id in the brute force is one more document of the same place
    assert of_search(got) == brute_search(docs, items, k)


def test_blocks_are_rejected_unpacked(corpus):
    """Block maxima and bounds leave most blocks of a long common list packed."""
    made = lexical_search.Inverter()
    for i in range(20_000):
        made.add(i, "common " * (1 + (i % 7 == 0)) + ("rare " * 3 if i % 1500 == 0 else f"x{i % 50}"))
    rows = {r.term: r for r in made.rows(0).itertuples(index=False)}
    norms = np.full(20_000, 100)
    lists = {
        t: lexical_search.List(
            pd.Series({**rows[t.encode()]._asdict(), "weight": w}), norms, lambda n: np.full(len(n), 100)
        )
        for t, w in (("common", 5), ("rare", 5000))
    }
    heap = lexical_search.Heap(3)
    lexical_search.search_shard([(held, 1) for held in lists.values()], np.arange(20_000), heap)
    assert heap.ids.tolist() == sorted(range(0, 20_000, 1500), key=lambda i: (-(i % 7 == 0), i))[:3]
    assert len(lists["common"].known) <= 64 + 14 < len(lists["common"].last) / 3


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert of_search(lexical_search.rank_documents(docs.limit(0), items)) == []
    assert of_search(lexical_search.rank_documents(docs, items.limit(0))) == []
    assert [r[:3] for r in of_search(lexical_search.rank_documents(docs, items))] == [(1, 1, 1)]


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**34], np.int64)
    assert lexical_search.unpacked(lexical_search.packed(values)[0]).tolist() == values.tolist()


def brute_negatives(rows, every):
    fit = []
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        fit.append((i, [math.floor(256 * x) for x in vector], label))

    def place(i):
        return math.inf if i is None else i

    out = []
    for a, (anchor, v, label) in enumerate(fit):
        if anchor is None or anchor % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w)), place(i), i, other)
            for b, (i, w, other) in enumerate(fit)
            if a != b and len(w) == len(v)
        ]
        scored.sort(key=lambda s: s[:2])
        for p, _, positive, _ in [s for s in scored if s[3] == label][:5]:
            inside = [s for s in scored if s[3] != label and -30 * p <= -100 * s[0] <= -90 * p]
            out += [(anchor, positive, r, s[2], -p, -s[0]) for r, s in enumerate(inside[:10], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5, 12))
    rows = []
    for i in range(700):
        label = 0 if i % 3 == 0 else int(rng.integers(0, 5))
        rows.append((i, (centres[label] * rng.uniform(0.2, 1) + rng.normal(0, 0.3, 12)).tolist(), label))
    rows += [(i + 5000, rows[i][1], rows[i][2]) for i in range(0, 60)]  # equal vectors: ties
    rows += [(None, rows[7][1], 1), (None, rows[8][1], 2), (20, rows[20][1], rows[20][2])]
    rows += [(9000, None, 1), (9010, rows[3][1], None), (9020, [None] * 12, 1), (9030, [math.nan] * 12, 2)]
    rows += [(9040, [math.inf] * 12, 2), (9050, [], 1), (9060, [0.0] * 12, 1), (9070, [1.0, 2.0], 1), (9071, [1.0, 1.0], 2)]
    rows += [(9080, [1e6] * 12, 1), (9090, [3e9] + [0.0] * 11, 2)]
    return rows


@pytest.mark.parametrize("block, chunk, slices", [(1024, 2048, 16), (16, 8, 2), (1, 1, 16)])
def test_negatives_equal_brute_force(spark, vectors, monkeypatch, block, chunk, slices):
    monkeypatch.setattr(hard_negatives, "SLICE", slices)
    monkeypatch.setattr(hard_negatives, "SLAB", 8 * slices)
    rows = [(*r, 1, "x") for r in (vectors if block > 1 else vectors[:90])]
    frame = spark.createDataFrame(
        rows, "vec_id long, embedding array<double>, label int, block int, chunk string"
    )
    got = hard_negatives.mine(frame, every=10, block=block, chunk=chunk).collect()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == brute_negatives([r[:3] for r in rows], 10)


def test_zones_leave_blocks_out(spark):
    """Two far clusters: an anchor reads the blocks of one of them only."""
    rng = np.random.default_rng(1)
    centre = {s: np.where(np.arange(8) < 4, 1 - s, s) for s in (0, 1)}
    rows = [
        (i, (centre[i % 2] + rng.normal(0, 0.05, 8)).tolist(), i % 2 + 10 * (i // 2 % 2)) for i in range(800)
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    blocks = hard_negatives.build_blocks(frame, 50)
    chunks = hard_negatives.anchor_chunks(blocks, 7, 1)
    n_chunks, n_blocks = chunks.count(), blocks.count()
    assert n_blocks == 16 and n_chunks > 8
    found = hard_negatives.best_vectors(chunks, blocks, n_chunks, n_blocks, 5)
    windows = found.groupBy("chunk").agg(
        hard_negatives.F.expr("collect_list(struct(anchor, rank - 1 as place, id, score)) as windows")
    )
    read = hard_negatives.wanted_blocks(chunks.join(windows, "chunk"), blocks, n_chunks, n_blocks, 10)
    assert 0 < read.count() < n_chunks * n_blocks / 2


@pytest.mark.parametrize("dims", [1, 2, 3, 5])
def test_curve_steps_to_a_neighbouring_cell(dims):
    cells = np.stack(np.meshgrid(*[range(4)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = hard_negatives.along_curve(cells)
    assert len(set(keys)) == 4**dims
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_negatives_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(frame).collect() == []


def library_counts(texts):
    library = Tokenizer.from_file(VOCABULARY)
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_equal_the_library():
    rng = random.Random(1)
    letters = "ab e'sdtlvrm  \n\t1 2²½é中　\xa0🙂\x1c\x85<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["<|endoftext|>" * 2, "a <|endoftext|> b", "a" * 3000, " " * 1000 + "x", "ab" * 5000, "", " "]
    texts += [f"a{chr(i)}b {chr(i)}1{chr(i)}" for i in range(1, 0x3100)]
    counter = token_counts.Counter(VOCABULARY)
    assert [counter.count(t) for t in texts] == library_counts(texts)


def test_long_piece_takes_no_quadratic_time():
    counter = token_counts.Counter(VOCABULARY)
    assert counter.count("abcdefgh" * 50_000) == library_counts(["abcdefgh" * 50_000])[0]


def test_token_counts_of_a_table(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "中文"), (2, None), (3, ""), (4, "word " * 600)]
    frame = spark.createDataFrame([(*r, 9, "t") for r in rows], "doc_id long, text string, n_tokens int, r string")
    got = token_counts.count_tokens(frame, VOCABULARY).collect()
    counts = library_counts([t or "" for _, t in rows])
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, counts)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(frame.limit(0), VOCABULARY).collect() == []
