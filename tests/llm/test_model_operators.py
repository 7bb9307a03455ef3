"""Substring dedup, vectors, BPE, HTML and toxicity against brute force or held-out data."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from segmill.llm import (
    anchors,
    bpe,
    embedding_lsh,
    html_extract,
    registered,
    substring,
    suffix_array,
    toxicity,
)

DOCS = "doc_id long, text string, n_chars long, sum int"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)

    def prose(n):
        return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(n))

    passage, copied = prose(80), prose(300)
    rows = [(i, f"{prose(60)} {passage} {prose(40)}") for i in range(6)]
    rows += [(10, copied), (11, copied), (11, copied), (12, copied + " end")]
    rows += [(20, None), (21, ""), (22, "short"), (None, copied[:700]), (23, "To " * 900)]
    rows += [(24, prose(20_000))]
    return spark.createDataFrame([(i, t, None if t is None else len(t), 0) for i, t in rows], DOCS)


def brute_bytes(texts):
    windows = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if windows[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        yield len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


def test_suffix_dedup(docs):
    texts = [(r.text or "").encode() for r in docs.collect()]
    got = [tuple(r)[1:] for r in suffix_array.digests(docs).collect()]
    assert sorted(got) == sorted(brute_bytes(texts))


def test_crowded_keys_give_the_same(docs, monkeypatch):
    wanted = sorted(map(str, suffix_array.digests(docs).collect()))
    later = sorted(map(str, substring.digests(docs).collect()))
    monkeypatch.setattr(anchors, "MAX_REGIONS", 1)
    assert sorted(map(str, suffix_array.digests(docs).collect())) == wanted
    assert sorted(map(str, substring.digests(docs).collect())) == later


def test_remove_repeats_keeps_characters(docs):
    got = suffix_array.remove_repeats(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows)
    assert {r.doc_id: r.text for r in rows}[20] is None


def test_substring_dedup(docs):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    order = [(-1 if d is None else d, w) for d, w in rows]
    first = {}
    for d, words in order:
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            first[window] = min(first.get(window, (d, i)), (d, i))
    wanted = []
    for d, words in order:
        gone = set()
        for i in range(len(words) - 19):
            if first[tuple(words[i : i + 20])] < (d, i):
                gone |= set(range(i, i + 20))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        wanted.append((len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r)[1:] for r in substring.digests(docs).collect()) == sorted(wanted)


def brute_words(rows):
    order = sorted((d, (t or "").encode().split()) for d, t in rows)
    seen, found = set(), []
    for d, words in order:
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        found.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return found


@pytest.mark.parametrize("parts", [1, 3])
def test_substring_dedup_of_copies_read_together(spark, parts):
    """Copies that one batch of rows holds lose all their words but the earliest."""
    rng = random.Random(11)
    space = [" ", "\n", "\t\r\n", "\x0b", "\x0c "]
    texts = []
    for _ in range(30):
        words = rng.choices(["a", "b", "é", "\u00a0", "\u2003x", "\x1c", "c\x00"], k=rng.randint(1, 90))
        texts.append("".join(w + rng.choice(space) for w in words))
    texts += [None, "", " ", "x " * 300, "x " * 20, "x " * 19, "x y " * 100]
    texts += [" ".join(rng.sample(texts[:30], 3)) for _ in range(10)]
    rows = list(zip(rng.sample(range(-50, 400), 150), rng.choices(texts, k=150)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(parts)
    assert sorted(map(tuple, substring.digests(docs).collect())) == brute_words(rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffix_array.digests(empty).count() == 0
    assert substring.digests(empty).count() == 0
    path = public_tokenizers.path(registered.RANKS)
    assert bpe.round_trip(empty, path, public_tokenizers.PATTERN).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(pages).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_lsh.near_duplicates(vectors).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors, labels = [], []
    for _ in range(60):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            vectors.append((base + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist())
            labels.append(int(rng.integers(0, 2)))
    vectors += [vectors[0], None, [0.0] * 16, [float("nan")] * 16, vectors[1], [1.0, 2.0], []]
    labels += [labels[0], 0, 0, 0, None, 0, 0]
    rows = list(zip(range(len(vectors)), vectors, labels))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [
        (i, np.array(v, float), y)
        for i, v, y in rows
        if v and y is not None and np.isfinite(v).all() and any(v)
    ]
    links = Counter()
    for i, a, y in good:
        for j, b, z in good:
            if i != j and y == z and len(a) == len(b):
                links[i] += a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93
    got = {r.vec_id: r for r in embedding_lsh.near_duplicates(frame).collect()}
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    assert 0.97 * sum(links.values()) <= found <= sum(links.values())
    assert got[len(rows) - 7].component_id == 0 and got[0].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in range(len(rows) - 6, len(rows)))


def test_sharded_buckets_give_the_same(spark, monkeypatch):
    frame = registered._table(spark, SF, "embeddings")
    wanted = sorted(map(tuple, embedding_lsh.near_duplicates(frame).collect()))
    monkeypatch.setattr(embedding_lsh, "SHARD", 3)
    monkeypatch.setattr(embedding_lsh, "SMALL", 2)
    assert sorted(map(tuple, embedding_lsh.near_duplicates(frame).collect())) == wanted


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(public_tokenizers.path(registered.RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path(registered.RANKS)),
        special_tokens={},
    )


def test_bpe_matches(codec, reference):
    rng = random.Random(1)
    parts = ["a", "th", "  ", " ", "\n", "\t", "é", "漢", "😀", "1", "'s", "!", "...", "\x1c", "\0", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 20_000, "".join(rng.choices(["st", "er", "x", "ing"], k=8000))]
    for text in texts:
        ids = codec.encode(text)
        assert ids == np.array(reference.encode_ordinary(text), "<u4").tobytes()
        assert b"".join(codec.decode(ids, chunk=3)) == text.encode()


def test_decoded_chunks_end_at_characters(codec):
    for chunk in codec.decode(codec.encode("漢字é😀 nö" * 50), chunk=1):
        chunk.decode()


def test_bpe_query(spark, reference):
    texts = {r.doc_id: r.text for r in registered._table(spark, SF, "documents").collect()}
    for row in registered.op9_bpe(spark, SF).collect():
        ids = reference.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_extraction_on_other_layouts():
    model = html_extract.trained()
    pages = [html_extract.parse(p) for p in html_extract.labelled_pages(200, seed=7)]
    forest = html_extract.Forest(pages)
    content = forest.marginals(model.weight, model.pair)[0] > 0.5
    wanted = np.array([n.content for p in pages for n in p.nodes])
    assert (content == wanted).mean() > 0.96


def test_extraction_of_a_page():
    page = (
        "<html><head><title>t</title><script>x='<p>no</p>'</script></head><body>"
        "<nav><a href=/>home</a></nav><article><h1>A&amp;B</h1><p>one\n two<br>three <b>bold"
        "<p>x &lt; y<!-- no --></p></article><section class=comments><p>first!</p></section>"
        "<footer>f</footer></body></html>"
    )
    parsed = [html_extract.parse(x) for x in (page, None, "", "<div>" * 3000)]
    assert html_extract.extract(parsed, html_extract.trained()) == [
        "A&B\n\none two three bold\n\nx < y", "", "", ""
    ]


def test_marginals_are_exact_on_a_small_tree():
    rng = np.random.default_rng(5)
    page = html_extract.parse("<div><p>a</p><p>b <i>c</i></p></div><nav>d</nav>")
    forest = html_extract.Forest([page])
    weight = rng.normal(size=html_extract.FEATURES)
    pair = rng.normal(size=(html_extract.N_KINDS, 2, 2))
    own = np.bincount(forest.element, weight[forest.slot], forest.size)
    n, total, on = forest.size, 0.0, np.zeros(forest.size)
    for code in range(1 << n):
        state = np.array([code >> i & 1 for i in range(n)])
        score = (own * state).sum() + sum(
            pair[forest.kind[i], state[forest.parent[i]], state[i]] for i in range(1, n)
        )
        total += np.exp(score)
        on += np.exp(score) * state
    assert forest.marginals(weight, pair)[0] == pytest.approx(on / total)


def test_toxicity_finds_unseen_misspellings():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(300)]
    toxic = [f"{t} {rng.choice(['idiot', 'moronic', 'pathetic'])}{rng.choice(['', 's', ','])}" for t in clean[:100]]
    model = toxicity.train(clean[100:] + toxic[:80], [0] * 200 + [1] * 80)
    scorer = toxicity.Scorer(model)
    assert np.mean([s >= 0.3 for s in scorer.scores(toxic[80:])]) > 0.9
    assert np.mean([s >= 0.3 for s in scorer.scores(clean[80:100])]) < 0.1
    assert scorer.scores([f"{clean[0]} idiotic!"])[0] >= 0.3
    assert all(0 <= s <= 1 for s in scorer.scores([None, "", "\ud800", "x" * 100_000]))


def test_toxicity_query(spark):
    rows = registered.op10_toxicity(spark, SF).collect()
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert row.predicted == int(row.score >= 0.3)
    assert len(rows) == registered._table(spark, SF, "documents").count()


@pytest.fixture(scope="module")
def insults():
    """Clean and toxic texts, and a model fitted on most of them."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(rng.randint(5, 300))) for _ in range(500)]
    toxic = [f"{t} {rng.choice(['idiot', 'moronic', 'pathetic'])}" for t in clean[:150]]
    return clean, toxic, toxicity.train(clean[150:] + toxic, [0] * 350 + [1] * 150)


def test_clean_texts_do_not_add_up(insults):
    clean, _, model = insults
    scorer = toxicity.Scorer(model)
    low = [t for t, s in zip(clean, scorer.scores(clean)) if s < 0.05]
    assert len(low) > 300
    joined = " ".join(low * 3)
    assert len(joined.split()) > 100_000
    assert scorer.scores([joined])[0] < 0.1
    assert min(scorer.scores([f"{joined} idiot", f"moronic {joined}"])) > 0.3


def test_toxicity_of_odd_tables(spark, insults):
    clean, toxic, model = insults
    kinds = "doc_id long, text string, score int, held_out string, toxic string"
    empty = spark.createDataFrame([], kinds)
    no_labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    columns = ["doc_id", "held_out", "score", "predicted"]
    assert toxicity.score_documents(empty, toxicity.fit(empty, no_labels)).columns == columns
    assert toxicity.score_documents(empty, model).count() == 0
    texts = [*clean[:20], *toxic[:20], toxic[0], None, ""]
    rows = [(i // 2 if i < 40 else None, t, 7, "x", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, kinds)
    assert {r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, no_labels)).collect()} == {0.5}
    got = toxicity.score_documents(docs, model).collect()
    assert sorted(r.score for r in got) == sorted(toxicity.Scorer(model).scores(texts))


def test_what_the_fit_learns_from(spark, monkeypatch):
    """Texts of any length, copies once, conflicting labels all, no held-out row, and no more than the bounds."""
    long = "word " * 50_000
    rows = [(i, f"text {i}") for i in range(60)] + [(1, long), (1, long), (1, "text 1"), (None, "none"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = [(i, i % 2) for i in range(60)] + [(1, 0), (1, 1), (None, 1), (3, None), (900, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, marks: seen.append(sorted(zip(map(str, texts), marks))))
    toxicity.fit(docs, labels)
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    wanted = {(f"text {i}", i % 2) for i in learned}
    if 1 in learned:
        wanted |= {("text 1", 0), (long, 0), (long, 1)}
    if 2 in learned:
        wanted.add(("None", 0))
    assert seen[0] == sorted(wanted)
    toxicity.fit(docs, labels, max_texts=10)
    toxicity.fit(docs.repartition(2), labels, max_texts=10)
    assert seen[1] == seen[2] and len(seen[1]) == 10
    toxicity.fit(docs.where("text <> 'x' and length(text) < 10"), labels, max_bytes=50)
    assert sum(len(t) for t, _ in seen[3]) in range(50, 57)


ARTICLE = "<article><h1>Title</h1><p>one two three four five six seven eight nine ten</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><body>{ARTICLE}</html>",
        f"<head><title>t</title><meta charset=utf-8><script>x</script>{ARTICLE}",
        f"<head><noscript><link></head><body>{ARTICLE}</body>",
        f"<body><nav><button>Menu</nav>{ARTICLE}</body>",
        f"<body><button>Menu{ARTICLE}</body>",
        f"<body><button>Menu{ARTICLE}<button>Other</button></body>",
        f"<body><nav><select><option>a<option>b</nav>{ARTICLE}</body>",
        f"<body><nav><svg><path d=1></nav>{ARTICLE}</body>",
        f"<body><noscript><img src=x>{ARTICLE}</body>",
        f"<body><nav><button><div>Menu</div><p>open</button></nav>{ARTICLE}</body>",
    ],
)
def test_text_after_what_is_left_open(page):
    texts = "".join(t for *_, t in html_extract.parse(page).texts)
    assert texts == "Titleone two three four five six seven eight nine ten"
    assert html_extract.extract([html_extract.parse(page)], html_extract.trained()) == [
        "Title\n\none two three four five six seven eight nine ten"
    ]


def test_copies_without_id_share_one_set_of_spans(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcde", k=5)) for _ in range(300))
    rows = [(None, text, 0, 0)] * 60 + [(1, "short", 0, 0), (None, text + " end", 0, 0)]
    frame = spark.createDataFrame(rows, DOCS).repartition(7)
    (longest,) = (
        anchors.repeated_windows(anchors.keyed(frame), suffix_array.SEARCH)
        .selectExpr("max(size(spans) - size(array_distinct(spans)))")
        .first()
    )
    assert longest == 0
    texts = [r[1].encode() for r in rows]
    got = [tuple(r)[1:] for r in suffix_array.digests(frame).collect()]
    assert sorted(got) == sorted(brute_bytes(texts))
    kept = [r.text for r in suffix_array.remove_repeats(frame).collect()]
    assert sorted(kept) == [""] * 60 + [" end", "short"]


def test_texts_whose_hashes_collide(docs, spark, monkeypatch):
    """Rows without an id stay apart by the second half of their texts' hashes."""
    rows = [(None if i % 2 else 5, r.text, r.n_chars, 0) for i, r in enumerate(docs.collect())]
    colliding = spark.createDataFrame(rows, DOCS)
    texts = [(r[1] or "").encode() for r in rows]
    monkeypatch.setattr(anchors, "SUM_MASK", 0)
    got = [tuple(r)[1:] for r in suffix_array.digests(colliding).collect()]
    assert sorted(got) == sorted(brute_bytes(texts))
    kept = Counter(r.n_chars for r in suffix_array.remove_repeats(colliding).where("text is not null").collect())
    assert kept[len("short")] == 1 and kept[len(rows[-1][1])] == 1
    # texts that share no window with another lose no word
    alone = {"short", rows[-1][1]}
    words = {(r.n_words, r.n_removed) for r in substring.digests(colliding).collect()}
    assert {(len(t.split()), 0) for t in alone} <= words


def planted_pairs(rng, n, dim, cosine):
    one = rng.normal(size=(n, dim))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other = rng.normal(size=(n, dim))
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return one, cosine * one + np.sqrt(1 - cosine**2) * other


@pytest.mark.parametrize("cosine, least", [(0.9301, 0.93), (0.95, 0.97), (0.97, 0.99), (0.99, 0.999)])
def test_recall_of_buckets(cosine, least):
    one, other = planted_pairs(np.random.default_rng(2), 4000, 64, cosine)
    met = (embedding_lsh.bucket_keys(one) == embedding_lsh.bucket_keys(other)).any(axis=1)
    assert met.mean() >= least


@pytest.mark.parametrize("scale", [1e-200, 1e200])
def test_buckets_do_not_depend_on_length(scale):
    vectors = np.random.default_rng(1).normal(size=(50, 64))
    same = embedding_lsh.bucket_keys(vectors * scale) == embedding_lsh.bucket_keys(vectors)
    # scaling rounds the last bit, which may move a projection over the border of its cell
    assert same.mean() > 0.999


def test_planted_links_are_found(spark):
    rng = np.random.default_rng(9)
    one, other = planted_pairs(rng, 200, 64, 0.98)
    apart = planted_pairs(rng, 200, 64, 0.90)
    rows = [(2 * i + k, v.tolist(), i % 3) for i, pair in enumerate(zip(one, other)) for k, v in enumerate(pair)]
    rows += [
        (1000 + 2 * i + k, v.tolist(), i % 3) for i, pair in enumerate(zip(*apart)) for k, v in enumerate(pair)
    ]
    rows += [(5000, (one[0] * 1e-200).tolist(), 0), (5001, (one[1] * 1e200).tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_lsh.near_duplicates(frame).collect()}
    linked = sum(got[2 * i].component_id == got[2 * i + 1].component_id for i in range(200))
    assert linked >= 198
    assert all(got[i].n_links == 0 for i in range(1000, 1400))
    assert got[5000].component_id == 0 and got[5001].component_id == 2


WORDS = " ".join(f"word{i % 97}" for i in range(300))
PARAGRAPHS = "".join(f"<p>{WORDS[:300]}.</p>" for _ in range(6))


@pytest.mark.parametrize(
    "page, holds, lacks",
    [
        (f"<body>{WORDS}</body>", WORDS, "nothing"),
        (f"<body><div>{WORDS}</div></body>", WORDS, "nothing"),
        (WORDS, WORDS, "nothing"),
        (f"<div id=content>{WORDS[:900]}<br><br>{WORDS}</div>", WORDS, "nothing"),
        (f"<body><nav><a href=/>Home</a></nav>{WORDS}<footer>Copyright 2020</footer></body>", WORDS, "Copyright"),
        (
            "<body><article><header><h1>Title</h1><p>By A</p></header>"
            f"{PARAGRAPHS}<footer><p>Posted in x</p></footer></article></body>",
            WORDS[:300],
            "Posted",
        ),
        (
            "<body><table><tr><td><a href=1>Home</a><br><a href=2>News</a><br><a href=3>About</a></td>"
            f"<td>{PARAGRAPHS}</td></tr></table></body>",
            WORDS[:300],
            "News",
        ),
    ],
)
def test_text_outside_of_paragraphs(page, holds, lacks):
    text = html_extract.extract([html_extract.parse(page)], html_extract.trained())[0]
    assert holds in text and lacks not in text


def test_depth_costs_in_proportion():
    def seconds(n):
        page = "<p>" + "<div>" * n + "<b>" * n + WORDS + "</x>" * n + "</div>" * n
        began = time.process_time()
        text = html_extract.extract([html_extract.parse(page)], html_extract.trained())[0]
        assert isinstance(text, str)
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 12 * seconds(4_000)
