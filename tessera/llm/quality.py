"""Quality verdicts from document statistics by boosted trees with monotonic constraints.

Statistics are taken of whole texts, in numpy, inside the tasks. The trees are
fitted on the driver on the statistics (never the texts) of a bounded sample of
labelled rows: the ``sample`` rows with the smallest hashes of their ids.

Defined results: null and empty texts have no words and fail the base rules;
ids without a label, or with a null label, are not learned from; repeated rows
each get their row. Without labelled rows of both kinds the trees say nothing
and the base rules decide.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.texts import batch_of, per_portion, raw
from tessera.llm.trees import Forest, fit

#: Labelled rows the trees are fitted on at most.
SAMPLE = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the trees see, with the direction in which a score may move.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "line_words": 0,
    "stop_share": 0,
    "digit_share": 0,
    "pipe_share": -1,
    "capital_share": 0,
    "distinct_share": 0,
    "end_mark_share": 0,
}

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
DIGITS = b"0123456789"
CAPITALS = bytes(range(65, 91))
INSIDE = bytes(range(0x80, 0xC0))  # bytes inside a character
MARKS = (b".", b"!", b"?", b":")


def n_repeated(words: list[bytes]) -> tuple[int, int]:
    """Words in windows of three that occur twice or more, and the distinct words."""
    n = len(words)
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    if n < 4:
        return 0, len(codes)
    pairs = ids[:-2] * len(codes) + ids[1:-1]
    if len(codes) > 2_000_000:  # products of three would not fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs * len(codes) + ids[2:]
    order = np.argsort(triples, kind="stable")
    ranked = triples[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum()), len(codes)


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The counts of ``COUNTS`` and the values of ``FEATURES`` of one text."""
    words = text.split()
    n = len(words)
    letters = len(text.translate(None, SPACES + INSIDE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = copies = ended = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            copies += line in seen
            seen.add(line)
            ended += line.rstrip(SPACES).endswith(MARKS)
    repeated, distinct = n_repeated(words)
    several = max(n, 1)
    short = sum(1 for w in words if len(w) < 4)
    count = lambda kept: len(text) - len(text.translate(None, kept))
    some = max(letters, 1)
    return [n, letters, symbols, copies, repeated], [
        float(np.log1p(n)),
        letters / several,
        symbols / some,
        copies / max(lines, 1),
        repeated / several,
        n / max(lines, 1),
        short / several,
        count(DIGITS) / some,
        text.count(b"|") / several,
        count(CAPITALS) / some,
        distinct / several,
        ended / max(lines, 1),
    ]


def measured(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """Counts of every text, with its features (no forest) or its score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = "features array<double>" if forest is None else "score double"

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [statistics(x) for x in raw(batch, "text")]
            counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS))
            features = np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES))
            if forest is None:
                end = {"features": pa.array(list(features), pa.list_(pa.float64()))}
            else:
                end = {"score": forest.score(features)}
            return batch_of(doc_id=batch.column("doc_id"), **dict(zip(COUNTS, counts.T.copy())), **end)

        return step

    counts = ", ".join(f"{name} bigint" for name in COUNTS)
    return per_portion(docs.select("doc_id", "text"), f"doc_id {kind}, {counts}, {last}", work)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees for ``labels.quality``, from rows whose crc32 of the id leaves a rest by 5."""
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    one = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = (
        one.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (rest != 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = (
        measured(texts, None)
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "features", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    x = np.array([r["features"] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r["quality"] > 0 for r in rows], float)
    return fit(x, y, {i: sign for i, sign in enumerate(FEATURES.values()) if sign})


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``score`` of every row of ``docs``."""
    scored = measured(docs, learn(docs, labels, sample))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(
        "doc_id",
        *COUNTS,
        failed.alias("base_failed"),
        (~failed & (F.col("score") >= least)).alias("kept"),
        "score",
    )
