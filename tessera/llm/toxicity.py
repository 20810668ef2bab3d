"""Toxicity scores from bags of subword embeddings under a linear softmax.

A word is the bag of its character n-grams (with marks for its ends) and itself,
hashed into ``BUCKETS`` rows of an embedding table. A document is the mean of
all its subword vectors, so a misspelling nobody labelled still shares most of
its vectors with the word it hides. Table and softmax are trained together, on
the driver, on a bounded sample: of the labelled rows outside the held-out
fifth, the ``sample`` with the smallest hashes of their ids whose texts have at
most ``LONGEST`` bytes. Scoring covers whole texts of any length: the model is
linear, so a word adds a fixed amount that a task works out once.

Defined results: null and empty texts have the score of the bias alone; a null
id is not held out and never learned from, as is a null label; labels that
disagree count as toxic; repeated rows each get their row. Without labels of
both kinds every score is the prior.
"""
from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.texts import per_portion, raw

#: Labelled rows learned from at most, and the bytes of a text among them at most.
SAMPLE, LONGEST = 6_000, 1 << 15
BUCKETS, WIDTH = 1 << 17, 8
#: Documents whose bags are worked on at once while training.
TOGETHER = 256
GRAMS = (3, 4, 5)
#: Distinct words a task remembers; what is dropped is worked out again.
CACHED = 500_000

#: ASCII punctuation and controls part words, but for signs that stand in for letters.
APART = bytes.maketrans(
    *(lambda cut: (cut, b" " * len(cut)))("".join(c for c in string.punctuation if c not in "@$*'-_").encode())
)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(APART).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all subwords of all words, one word after the other, and how many each has."""
    flat = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    base = np.uint64(0x9E3779B97F4A7C15)
    prefix = np.uint64(0)
    found, owner = [], []
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):  # one byte more in each round
            shifted = flat[n - 1 :]
            prefix = (prefix[: len(shifted)] if n > 1 else prefix) * base + shifted + np.uint64(n)
            if n in GRAMS:
                inside = word[: len(shifted)] == word[n - 1 :]
                found.append(prefix[inside])
                owner.append(word[: len(shifted)][inside])
        # The whole word: its bytes times powers that depend on their place.
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        power = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, base, np.uint64))
        whole = np.add.reduceat(flat * power[place], np.cumsum(sizes) - sizes) if len(words) else flat
        found.append(whole)
        owner.append(np.arange(len(words)))
        ids = np.concatenate(found)
        ids = (ids ^ (ids >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (ids >> np.uint64(47)).astype(np.int64)[order], np.bincount(owner, minlength=len(words))


@dataclass
class Model:
    """What is left of table and softmax for scoring: the logit each bucket adds, and the bias."""

    table: np.ndarray
    bias: float

    def worth(self, words: list[bytes]) -> np.ndarray:
        """For each word its summed logit and, as the imaginary part, its number of subwords."""
        if not words:
            return np.zeros(0, complex)
        ids, counts = subwords(words)
        return np.add.reduceat(self.table[ids], np.cumsum(counts) - counts) + 1j * counts

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits + self.bias, -40, 40)))


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    counted = Counter(words_of(text))
    if not counted:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids, sizes = subwords(list(counted))
    weight = np.repeat(np.fromiter(counted.values(), float, len(counted)), sizes)
    buckets, inverse = np.unique(ids, return_inverse=True)
    shares = np.bincount(inverse, weight)
    return buckets.astype(np.int32), (shares / shares.sum()).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, steps: int = 100, rate: float = 0.1, decay: float = 1e-6, seed: int = 1) -> Model:
    """Fit embeddings and softmax together by full-batch Adam.

    With two classes the softmax sees the difference ``w`` of its rows only. The
    gradient of the table is the outer product of one value per bucket and
    ``w``, so a step costs two passes over the bags, whatever the width.
    """
    y = np.asarray(labels, float)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    bias = float(np.log(prior / (1 - prior)))
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS), bias)
    chunks = []
    for start in range(0, len(texts), TOGETHER):
        bags = [bag(x) for x in texts[start : start + TOGETHER]]
        sizes = np.array([len(b) for b, _ in bags])
        filled = np.flatnonzero(sizes)
        buckets, shares = (np.concatenate(x) for x in zip(*bags))
        chunks.append((slice(start, start + len(bags)), sizes, filled, (np.cumsum(sizes) - sizes)[filled], buckets, shares))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    w = rng.normal(0, 1.0, WIDTH)
    values = [table, w, np.array([bias])]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        table, w, b = values
        worth, pull, off = table @ w, np.zeros(BUCKETS), 0.0
        for rows, sizes, filled, starts, buckets, shares in chunks:
            logits = np.full(len(sizes), b[0])
            if len(filled):
                logits[filled] += np.add.reduceat(worth[buckets] * shares, starts)
            wrong = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y[rows]) / len(y)
            pull += np.bincount(buckets, np.repeat(wrong, sizes) * shares, BUCKETS)
            off += wrong.sum()
        slopes = [np.outer(pull, w) + decay * table, table.T @ pull + decay * w, np.array([off])]
        for v, g, m, s in zip(values, slopes, first, second):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    table, w, b = values
    return Model(table @ w, float(b[0]))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labels.toxic`` and the texts of the rows that are not held out."""
    one = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Twice the sample leaves enough after long texts and ids without a document.
    chosen = one.where(F.col("toxic").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    rows = (
        docs.select("doc_id", "text")
        .where(F.octet_length("text") <= LONGEST)
        .join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(sample)
        .collect()
    )
    rows = [(r["text"].encode(), float(r["toxic"] > 0)) for r in rows]
    return train([text for text, _ in rows], np.array([label for _, label in rows]))


def scored(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in the new (or replaced) column ``into``."""
    kept = [c for c in docs.columns if c != into]
    schema = T.StructType([*docs.select(kept).schema.fields, T.StructField(into, T.DoubleType())])

    def work():
        known: dict[bytes, complex] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            split = [words_of(x) for x in raw(batch, "text")]
            if len(known) > CACHED:
                known.clear()
            new = list(set().union(*split) - known.keys())
            known.update(zip(new, model.worth(new).tolist()))
            sums = np.array([sum(map(known.__getitem__, words), 0j) for words in split], complex)
            score = pa.array(model.score(sums.real / np.maximum(sums.imag, 1)))
            return pa.RecordBatch.from_arrays([*batch.columns, score], names=schema.names)

        return step

    return per_portion(docs.select(kept), schema, work)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    out = scored(docs.select("doc_id", "text"), learn(docs, labels, sample))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
