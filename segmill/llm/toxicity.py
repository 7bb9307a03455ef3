"""Toxicity from bags of subwords.

A word is the bag of its character n-grams, hashed to rows of an embedding table and
averaged; a linear softmax over that average gives its odds. Embeddings and softmax are
trained together, so words never seen share the vectors of their n-grams with those that
were. The odds of a stretch of ``STRETCH`` words are those of its words taken together,
their log-sum-exp, and a text's are those of its worst stretch: more clean text does not
add up to a toxic one, and an insult weighs as much in a long text as in a short one.

The model is fitted in numpy on a bounded sample of the labelled texts, of any length:
the first ``MAX_TEXTS`` by a hash of their id, up to the one that fills ``MAX_BYTES``
together. Scoring covers every text whole. With two classes a word enters the softmax by
one number, its weight, so what the workers get is one number per table row.

A null or empty text has no words and scores what the softmax gives without any.
Texts without a label are scored like others. Rows that repeat an id are scored one
by one; those that repeat id and text are learned from once, and conflicting labels of
an id all count. Labels without an id are not used. An empty table gives an empty
result; without labelled texts of both classes the score is 0.5 everywhere. Other
columns do not matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TEXTS = 4000
MAX_BYTES = 24 << 20
BUCKETS = 1 << 17
DIM = 8
SHORTEST, LONGEST = 3, 6
STRETCH = 256
ROUNDS = 100
RATE = 1.0
DECAY = 1e-4
FLOOR = 1e-3
SEED = 42
THRESHOLD = 0.3
MAX_CACHED = 700_000


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, table row) of every n-gram of some words, each word between marks."""
    marked = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    found, rows = [], []
    hashed = points
    for size in range(2, LONGEST + 1):
        hashed = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[size - 1 :]
        if size >= SHORTEST:
            inside = np.flatnonzero(left[: len(hashed)] >= size)
            h = hashed[inside] ^ (hashed[inside] >> np.uint64(29))
            found.append(word[inside])
            rows.append(((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(47)).astype(np.int32))
    return np.concatenate(found), np.concatenate(rows)


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


def pooled(odds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-sum-exp of the words of each stretch, and each word's share in it."""
    top = np.maximum.reduceat(odds, first)
    n = np.diff(np.r_[first, len(odds)])
    weight = np.exp(odds - np.repeat(top, n))
    total = np.add.reduceat(weight, first)
    return top + np.log(total), weight / np.repeat(total, n)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _sums(values: np.ndarray, of: np.ndarray, into: np.ndarray, n: int, block: int = 1 << 20):
    """Sum of ``values[of]`` by ``into``, in blocks that keep copies small."""
    total = np.zeros(n)
    for at in range(0, len(of), block):
        total += np.bincount(into[at : at + block], values[of[at : at + block]], n)
    return total


def _first_of(chosen: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """1 for the first chosen stretch of each text, 0 for the others."""
    at = np.flatnonzero(chosen)
    first = np.zeros(len(chosen))
    first[at[np.unique(of_text[at], return_index=True)[1]]] = 1
    return first


def train(texts: list[str], labels: list[int]) -> Model:
    """Fit embeddings and softmax together by Adam over all texts at once.

    Only the difference between the two classes matters, so the softmax is one
    vector and one bias. The gradient of an embedding row is its number of uses,
    weighted, times that vector.
    """
    numbers: dict[str, int] = {}
    found = []
    for text, label in zip(texts, labels):
        if words := split(text):
            found.append((np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32), label))
    if len({label for _, label in found}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    tokens = np.concatenate([words for words, _ in found])
    vocabulary = list(numbers)
    parts = [subwords(vocabulary[i : i + 50_000]) for i in range(0, len(vocabulary), 50_000)]
    of_word = np.concatenate([w + 50_000 * i for i, (w, _) in enumerate(parts)]).astype(np.int32)
    row = np.concatenate([r for _, r in parts])
    del parts, vocabulary
    uses = np.maximum(np.bincount(of_word, minlength=len(numbers)), 1)
    sizes = np.array([len(words) for words, _ in found])
    n_stretches = -(-sizes // STRETCH)
    text_first = np.cumsum(n_stretches) - n_stretches
    of_text = np.repeat(np.arange(len(sizes)), n_stretches)
    nth = np.arange(len(of_text)) - text_first[of_text]
    stretch_first = (np.cumsum(sizes) - sizes)[of_text] + nth * STRETCH
    stretch_size = np.diff(np.r_[stretch_first, len(tokens)])  # the last of a text may be short
    y = np.array([label for _, label in found], np.float64)

    rng = np.random.default_rng(SEED)
    embedding = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    softmax = rng.normal(0, 1, DIM)
    bias = np.array([-4.0])
    parameters = [embedding, softmax, bias]
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    for step in range(1, ROUNDS + 1):
        along = embedding @ softmax
        word = _sums(along, row, of_word, len(numbers)) / uses
        odds, share = pooled(word[tokens], stretch_first)
        text_odds = np.maximum.reduceat(odds, text_first) + bias[0]
        worst = _first_of(odds == (text_odds - bias[0])[of_text], of_text)
        error = (sigmoid(text_odds) - y) / len(y)
        by_token = share * np.repeat(worst * error[of_text], stretch_size)
        by_word = np.bincount(tokens, by_token, len(numbers))
        by_row = _sums(by_word / uses, of_word, row, BUCKETS)
        gradients = [
            by_row[:, None] * softmax + DECAY * embedding / len(y),
            embedding.T @ by_row,
            np.array([error.sum()]),
        ]
        for p, g, m, v in zip(parameters, gradients, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + FLOOR)
    return Model((embedding @ softmax).astype(np.float32), float(bias[0]))


class Scorer:
    """Scores texts; the weight of a word is kept once worked out."""

    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, float] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > MAX_CACHED:
            self.words.clear()
            new = list(words)
        if new:
            of_word, row = subwords(new)
            uses = np.maximum(np.bincount(of_word, minlength=len(new)), 1)
            weight = np.bincount(of_word, self.model.weights[row], len(new)) / uses
            self.words.update(zip(new, weight.tolist()))

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.model.weights.any():  # nothing was learned
            return [0.5] * len(texts)
        return [s for at in range(0, len(texts), 256) for s in self._some(texts[at : at + 256])]

    def _some(self, texts: list[str | None]) -> list[float]:
        found = [split(t) for t in texts]
        self.learn(set().union(*found))
        out = []
        for words in found:
            odds = np.zeros(1)
            if words:
                odds = np.fromiter(map(self.words.__getitem__, words), np.float64, len(words))
            stretches, _ = pooled(odds, np.arange(0, len(odds), STRETCH))
            out.append(float(sigmoid(stretches.max() + self.model.bias)))
        return out


def held_out() -> Column:
    """Rows whose labels are never learned."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on a bounded, repeatable sample of the labelled texts that are not held out.

    At most ``max_texts`` labels, and as many keys of texts, are broadcast; texts are read
    once the keys are chosen, so texts that are not in the sample never leave their task.
    """
    place = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    picked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out())
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .distinct()
        .orderBy(place, "doc_id", "toxic")
        .limit(max_texts)
    )
    keyed = docs.select("doc_id", F.xxhash64("text").alias("content"), "text")
    sized = keyed.select("doc_id", "content", F.octet_length("text").alias("size"))
    keys = (
        sized.join(F.broadcast(picked), "doc_id")
        .distinct()
        .orderBy(place, "doc_id", "toxic", "content", "size")
        .limit(max_texts)
    )
    chosen, held = [], 0
    for key in keys.collect():
        if held >= max_bytes:
            break
        chosen.append(key)
        held += key["size"] or 0
    # rows of one id and content are copies; the aggregate keeps one of them per task
    sample = docs.sparkSession.createDataFrame(chosen, keys.schema).drop("size")
    rows = (
        keyed.join(F.broadcast(sample), ["doc_id", "content"])
        .groupBy("doc_id", "content", "toxic")
        .agg(F.min("text").alias("text"))
        .toPandas()
        .sort_values(["doc_id", "content", "toxic"])
    )
    return train(list(rows["text"]), list(rows["toxic"]))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorer: list[Scorer] = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not scorer:
            scorer.append(Scorer(shared.value))
        return pd.Series(scorer[0].scores(list(texts)), dtype="float64")

    return docs.select(
        "doc_id", held_out().alias("held_out"), scored("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
