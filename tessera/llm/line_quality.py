"""Document quality from a linear-chain conditional random field over lines.

Every line is a node with two states, bad and good. What speaks for a state are
statistics of the line and of its two neighbours, cut into bins, and how the line
before is labelled. Lines of a labelled document carry its label in training;
weights and transitions are fitted together by gradients of the exact likelihood
of these chains, on the driver, on the statistics (never the texts) of a bounded
sample: of the labelled rows whose crc32 leaves another rest by 4 than 2, the
``sample`` with the smallest hashes of their ids whose texts have at most
``LONGEST`` bytes and ``LINES`` lines.

Scoring covers whole texts of any length. Forward and backward messages of all
lines of a portion come from prefix and suffix products of their two-by-two
matrices, by doubling; the matrix of a first line has equal rows, which ends what
reaches it from other documents. The score is the mean of the marginals of good,
each weighted with the bytes of its line's words.

Defined results: lines end at ``\\n`` only, words are runs of anything but space
and the characters 9 to 13; a text without words (null and empty too) has the
plain mean of its lines' marginals; ids that are null, or have no or a null
label, are not learned from, disagreeing labels count as good; repeated rows each
get their row; without labels of both kinds every score is the prior; an empty
table has no rows; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.texts import batch_of, per_portion, raw

#: Labelled rows learned from at most, and the bytes and lines of a text among them at most.
SAMPLE, LONGEST, LINES = 6_000, 1 << 15, 512
#: Bins of a statistic, and bytes whose lines are measured at once.
BINS, PIECE = 10, 1 << 19

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "capitals", "digits", "marks", "symbols", "foreign",
    "ends", "begins", "same_as_before", "repeated", "short_words", "long_words", "lone_symbols", "copied", "document_copies",
)

SPACE, CAPITAL, SMALL, DIGIT, MARK, SYMBOL, FOREIGN = range(7)
KINDS = np.full(256, SYMBOL, np.uint8)
KINDS[[0x20, *range(9, 14)]] = SPACE
KINDS[65:91], KINDS[97:123], KINDS[48:58], KINDS[128:] = CAPITAL, SMALL, DIGIT, FOREIGN
KINDS[list(b".,;:!?'\"()-")] = MARK
CLOSES = np.isin(np.arange(256), list(b".!?:"))

FACTOR = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def later_equal(keys: np.ndarray) -> np.ndarray:
    """Which keys occur earlier in the list."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def line_statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``STATISTICS`` of all lines of all texts, the bytes of their words, and the number of lines of each text."""
    data = np.frombuffer(b"".join(x + b"\n" for x in texts), np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    lines = np.diff(np.searchsorted(ends, np.cumsum(sizes)) + 1, prepend=0)
    found, at, base = [], 0, 0
    while at < len(ends):  # whole lines of some ``PIECE`` bytes at a time
        stop = max(at + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        found.append(measured_lines(data[base : ends[stop - 1]], ends[at:stop] - base))
        at, base = stop, int(ends[stop - 1])
    statistics, size, hashes = (np.concatenate(x) for x in zip(*found))
    document = np.repeat(np.arange(len(texts)), lines)
    with np.errstate(over="ignore"):
        copy = later_equal(mixed(hashes + document.astype(np.uint64) * FACTOR)) & (size > 0)
    full = np.bincount(document, size > 0, minlength=len(texts))
    copies = np.bincount(document, copy, minlength=len(texts)) / np.maximum(full, 1)
    return np.column_stack([statistics, copy, copies[document]]).astype(np.float32), size, lines


def measured_lines(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``STATISTICS`` but the last two, bytes of words and a hash, of the lines that end before ``ends``."""
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    line = np.repeat(np.arange(n), ends - starts)
    kinds = KINDS[data]
    counts = np.bincount(line * 7 + kinds, minlength=7 * n).reshape(n, 7)
    size = counts.sum(axis=1) - counts[:, SPACE]
    some = np.maximum(size, 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], kinds != SPACE, [False]])))
    begin, end = edge[::2], edge[1::2]
    owner, long = line[begin], end - begin
    with np.errstate(over="ignore"):
        # Hashes of any run of bytes, from running sums of bytes times powers.
        one = np.ones(1, np.uint64)
        power = np.multiply.accumulate(np.append(one, np.full(len(data), FACTOR)))
        inverse = np.multiply.accumulate(np.append(one, np.full(len(data), BACK)))
        running = np.append(np.zeros(1, np.uint64), np.cumsum((data + one) * power[:-1]))
        word, hashes = (mixed((running[b] - running[a]) * inverse[a]) for a, b in ((begin, end), (starts, ends)))
        again = later_equal(mixed(word + owner.astype(np.uint64) * FACTOR))
    n_words = np.bincount(owner, minlength=n)
    several = np.maximum(n_words, 1)
    share = lambda which: np.bincount(owner, which, minlength=n) / several
    stays = np.zeros(len(word), bool)
    stays[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    longest, last, first = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
    filled = np.flatnonzero(n_words)
    if len(filled):
        after = np.cumsum(n_words)[filled]
        at = after - n_words[filled]
        longest[filled] = np.maximum.reduceat(long, at)
        first[filled], last[filled] = kinds[begin[at]] == CAPITAL, CLOSES[data[end[after - 1] - 1]]
    columns = [
        np.log1p(size), np.log1p(n_words), size / several, np.log1p(longest),
        *(counts[:, kind] / some for kind in (CAPITAL, DIGIT, MARK, SYMBOL, FOREIGN)),
        last, first, share(stays), share(again), share(long < 3), share(long > 16), share((long == 1) & (kinds[begin] == SYMBOL)),
    ]
    return np.stack(columns, axis=1).astype(np.float32), size, hashes


@dataclass
class Field:
    """Bin edges, what each bin of a line, the line before and the line after speaks for good, and how states follow."""

    edges: np.ndarray  # statistic x inner edge
    weight: np.ndarray  # (statistic, bin) x (line itself, line before, line after)
    first: float  # of a line without one before
    last: float  # of a line without one after
    bias: float
    follow: np.ndarray  # state x next state

    def bins(self, statistics: np.ndarray) -> np.ndarray:
        """Columns of ``weight`` that a line has."""
        found = [np.searchsorted(e, x, side="right") for e, x in zip(self.edges, statistics.T)]
        return np.stack(found, axis=1) + np.arange(len(self.edges)) * BINS if found else np.zeros((len(statistics), 0), np.int64)

    def speaks(self, bins: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The logit of good that each line has by itself and its neighbours; ``begins`` marks first lines."""
        own = self.weight[bins].sum(axis=1)
        closes = np.append(begins[1:], True)
        out = own[:, 0] + self.bias
        out[1:] += np.where(begins[1:], 0, own[:-1, 1])
        out[:-1] += np.where(closes[:-1], 0, own[1:, 2])
        return np.clip(out + self.first * begins + self.last * closes, -30, 30)

    def marginals(self, logits: np.ndarray, begins: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
        """The probability of good for each line, and of each (state, next state) for each line and the one after.

        ``lines`` is the length of the longest chain.
        """
        matrix = np.exp(self.follow)[None] * np.stack([np.ones_like(logits), np.exp(logits)], axis=1)[:, None, :]
        matrix[begins] = np.stack([np.ones_like(logits), np.exp(logits)], axis=1)[begins][:, None, :]
        matrix /= matrix.max(axis=(1, 2), keepdims=True)
        before, after, reach = matrix, matrix, 1
        while reach < lines + 1:
            if reach < len(matrix):
                before = np.concatenate([before[:reach], scaled(before[:-reach] @ before[reach:])])
                after = np.concatenate([scaled(after[:-reach] @ after[reach:]), after[-reach:]])
            reach *= 2
        forward = before[:, 0]
        backward = np.ones_like(forward)
        backward[:-1] = after[1:].sum(axis=2)
        both = forward * backward
        pairs = forward[:-1, :, None] * matrix[1:] * backward[1:, None, :]
        return both[:, 1] / both.sum(axis=1), pairs / pairs.sum(axis=(1, 2), keepdims=True)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        statistics, size, lines = line_statistics(texts)
        begins = np.zeros(len(size), bool)
        starts = np.cumsum(lines) - lines
        begins[starts] = True
        good = self.marginals(self.speaks(self.bins(statistics), begins), begins, int(lines.max()))[0]
        empty = np.add.reduceat(size, starts) == 0
        weight = np.where(np.repeat(empty, lines), 1, size)
        return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1)


def scaled(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(matrix.max(axis=(1, 2), keepdims=True), 1e-300)


def train(chains: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.05, decay: float = 1e-4, together: int = 256, seed: int = 1) -> Field:
    """Fit a field to the statistics of the lines of documents and the documents' labels, by Adam."""
    y = np.asarray(labels, float)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    k = len(STATISTICS)
    start = Field(np.zeros((k, BINS - 1)), np.zeros((k * BINS, 3)), 0.0, 0.0, float(np.log(prior / (1 - prior))), np.zeros((2, 2)))
    if not len(y) or y.min() == y.max():
        return start
    everything = np.concatenate(chains)
    edges = np.quantile(everything, np.arange(1, BINS) / BINS, axis=0).T
    # Equal quantiles leave bins empty; the middles between distinct values of rare kinds take their place.
    for i, column in enumerate(everything.T):
        values = np.unique(column)
        if len(values) <= BINS:
            edges[i] = np.append((values[1:] + values[:-1]) / 2, np.full(BINS - len(values), np.inf))
        elif len(np.unique(edges[i])) < BINS - 1:
            most, rest = edges[i][0], column[column > edges[i][0]]
            if len(rest):
                edges[i] = np.append((most + rest.min()) / 2, np.quantile(rest, np.arange(1, BINS - 1) / (BINS - 1)))
    values = {"weight": start.weight, "ends": np.array([0.0, 0.0, start.bias]), "follow": start.follow}
    first, second = ({name: np.zeros_like(v) for name, v in values.items()} for _ in range(2))
    field = Field(edges, values["weight"], 0.0, 0.0, start.bias, values["follow"])
    by_length = np.argsort([len(c) for c in chains], kind="stable")  # alike in length, so that few doublings are wasted
    batches = np.array_split(by_length, max(1, len(chains) // together))
    binned = [field.bins(np.concatenate([chains[i] for i in batch])) for batch in batches]
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for which in rng.permutation(len(batches)):
            batch, bins = batches[which], binned[which]
            lines = np.array([len(chains[i]) for i in batch])
            begins = np.zeros(len(bins), bool)
            begins[np.cumsum(lines) - lines] = True
            closes = np.append(begins[1:], True)
            truth = np.repeat(y[batch], lines)
            field = Field(edges, values["weight"], *values["ends"].tolist(), values["follow"])
            good, pairs = field.marginals(field.speaks(bins, begins), begins, int(lines.max()))
            wrong = (good - truth) / len(batch)
            pull = np.zeros((3, k * BINS))
            for place, off in enumerate((wrong, np.where(closes, 0, np.append(wrong[1:], 0)), np.where(begins, 0, np.append(0, wrong[:-1])))):
                pull[place] = np.bincount(bins.ravel(), np.repeat(off, k), k * BINS)
            inside = ~begins[1:]
            seen = np.bincount((truth[:-1] * 2 + truth[1:]).astype(int)[inside], minlength=4).reshape(2, 2)
            slopes = {
                "weight": pull.T + decay * values["weight"],
                "ends": np.array([wrong[begins].sum(), wrong[closes].sum(), wrong.sum()]),
                "follow": (pairs[inside].sum(axis=0) - seen) / len(batch) + decay * values["follow"],
            }
            step += 1
            for name, slope in slopes.items():
                first[name] += 0.1 * (slope - first[name])
                second[name] += 0.01 * (slope * slope - second[name])
                values[name] = values[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return Field(edges, values["weight"], *values["ends"].tolist(), values["follow"])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from ``labels.quality`` and the lines of the rows that are not held out."""
    one = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # Twice the sample leaves enough after long texts and ids without a document.
    chosen = one.where(F.col("quality").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    short = (F.octet_length("text") <= LONGEST) & (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < LINES)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(short).join(F.broadcast(chosen), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            statistics, _, lines = line_statistics(raw(batch, "text"))
            parts = np.split(statistics, np.cumsum(lines)[:-1])
            found = pa.array([part.astype("<f4").tobytes() for part in parts], pa.binary())
            return batch_of(doc_id=batch.column("doc_id"), quality=batch.column("quality"), lines=found)

        return step

    measured = per_portion(texts.select("doc_id", "text", F.col("quality").cast("int").alias("quality")), f"doc_id {kind}, quality int, lines binary", work)
    rows = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "lines").limit(sample).collect()
    chains = [np.frombuffer(bytes(r["lines"]), "<f4").reshape(-1, len(STATISTICS)) for r in rows]
    return train(chains, np.array([float(r["quality"] > 0) for r in rows]))


def line_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    field = learn(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch_of(doc_id=batch.column("doc_id"), score=field.score(raw(batch, "text")))

        return step

    scored = per_portion(docs.select("doc_id", F.col("text").cast("string").alias("text")), f"doc_id {kind}, score double", work)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
