"""Every stage of the pipeline and the whole of it, on planted cases, against plain Python."""

from __future__ import annotations

import base64
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from segmill.llm import registered

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return (text or "").encode().split()


def passes(text):
    """The quality policy, rule by rule."""
    words, text = words_of(text), text or ""
    n = len(words)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    chars = sum(len(w.decode()) for w in words)
    return not (
        n < 50
        or 100 * len(covered) > 50 * n
        or 10 * sum(text.count(c) for c in "#*$%&|<>") > n
        or 2 * (len(lines) - len(set(lines))) > len(lines)
        or 10 * text.count("!") > 3 * n
        or chars < 2 * n
        or chars > 12 * n
    )


def fingerprint(text):
    words = [w.lower() for w in words_of(text)]
    if not words:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def one_of_each_class(rows):
    prints = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                one, two = sorted((find(i), find(j)))
                root[two] = one
    return sorted({find(i) for i in prints})


def without_repeats(texts):
    data = [t.encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    out = []
    for t in data:
        gone = set()
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone |= set(range(i, i + 200))
        text, at = [], 0
        for c in t.decode():
            size = len(c.encode())
            if not gone.issuperset(range(at, at + size)):
                text.append(c)
            at += size
        out.append("".join(text))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghijé", k=rng.randint(2, 8))) for _ in range(n))

    passage = prose(60)
    clean = [prose(rng.randint(60, 300)) for _ in range(60)]
    clean += [f"{prose(100)}\n{passage}\n{prose(100)}" for _ in range(4)]
    long = prose(3000)
    near = long.split()
    near[1500] = "changed"
    texts = clean + [clean[3], clean[3], clean[5], long, " ".join(near)]
    texts += ["too short", "! " * 200, "word " * 100, "# $ % & " * 60, None, ""]
    rows = [(i, t, "en", "abc"[rng.randrange(3)] if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage got and gave."""
    found, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, corpus_pipeline.materialize(stage(spark, docs, folder), name)
        found[name] = given, docs
    return found


def of(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_quality_rules(stages):
    given, got = stages["quality_rules"]
    assert got.columns == given.columns
    assert sorted(of(got)) == sorted(i for i, r in of(given).items() if passes(r.text))


def test_near_dedup(stages):
    given, got = stages["simhash_near_dedup"]
    assert got.columns == given.columns
    rows = of(given)
    kept = one_of_each_class([(i, r.text) for i, r in rows.items()])
    assert sorted(of(got)) == kept
    # exact copies and the text with a word changed
    assert not {64, 65, 66, 68} & set(kept) and {3, 5, 67} <= set(kept)
    assert all(of(got)[i] == rows[i] for i in kept)


def test_suffix_dedup(stages):
    given, got = stages["suffix_array_dedup"]
    assert got.columns == given.columns
    rows, after = of(given), of(got)
    want = dict(zip(rows, without_repeats([r.text for r in rows.values()])))
    assert {i: r.text for i, r in after.items()} == want
    assert any(len(want[i]) < len(r.text) for i, r in rows.items())
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_mix(stages):
    given, got = stages["mix_sources"]
    assert got.columns == given.columns
    size = Counter()
    for r in given.collect():
        size[r.source] += len(words_of(r.text))
    taken, of_doc = Counter(), Counter()
    texts = {i: words_of(r.text) for i, r in of(given).items()}
    for r in got.collect():
        taken[r.source] += len(words_of(r.text))
        of_doc[r.doc_id] += len(words_of(r.text))
        # blocks of a pass in their order
        rest = iter(texts[r.doc_id])
        assert all(word in rest for word in words_of(r.text))
    total = sum(size.values())
    # three sources and null, weights 1, 2, 3, 1
    weights = {"a": 1, "b": 2, "c": 3, None: 1}
    left, target = float(total), {}
    while len(target) < len(size):
        level = left / sum(w for s, w in weights.items() if s not in target)
        over = [s for s, w in weights.items() if s not in target and w * level > 3 * size[s]]
        for s in over or [s for s in weights if s not in target]:
            target[s] = 3 * size[s] if over else weights[s] * level
        left = total - sum(target.values())
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert all(n <= 3 * len(words_of(of(given)[i].text)) for i, n in of_doc.items())


def test_tokens(stages):
    given, got = stages["bpe_tokens"]
    with open(public_tokenizers.path(registered.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    want = Counter()
    for r in given.collect():
        ids = library.encode_ordinary(r.text)
        want[r.doc_id, len(ids), b"".join(i.to_bytes(4, "little") for i in ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in got.collect()) == want


def test_run(spark, folder, stages):
    last = Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in stages["bpe_tokens"][1].collect())
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in got) == last


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
