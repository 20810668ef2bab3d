import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm.quality import quality
from tessera.llm.queries import QUERIES
from tessera.llm.trees import fit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, len(covered), failed


def test_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op7_quality_rules"](spark, sf).collect()
    assert len(got) == len(docs)
    for row in got:
        assert tuple(row)[1:7] == base(docs[row["doc_id"]])
        assert not (row["base_failed"] and row["kept"])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"]: r for r in QUERIES["op7_quality_rules"](spark, sf).collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    right = [(kept[d]["score"] >= 0.5) == (labels[d] == 1) for d in held]
    assert len(held) > 50 and np.mean(right) > 0.95


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, 0, "x"), (3, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    got = quality(odd, labels).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in got) == sorted((str(r["doc_id"]), base(r["text"])[0]) for r in odd.collect())
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality(odd.limit(0), labels).collect() == []
    assert quality(odd, labels.limit(0)).count() == odd.count()


@pytest.mark.parametrize("sign", [1, -1])
def test_monotone(sign):
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = (sign * x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.2, 800) > (0.5 if sign < 0 else 1.0)).astype(float)
    forest = fit(x, y, {0: sign})
    for row in x[:50]:
        line = np.tile(row, (60, 1))
        line[:, 0] = np.linspace(-0.2, 1.2, 60)
        assert (sign * np.diff(forest.score(line)) >= -1e-12).all()
    assert np.mean((forest.score(x) >= 0.5) == (y == 1)) > 0.85


def test_scores_by_a_walk_through_every_tree(spark, sf):
    """Score and verdict of each document from its statistics, one node after the other."""
    from tessera.llm.quality import learn, statistics

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = learn(docs, labels)
    inner = 2**forest.depth - 1
    got = {r["doc_id"]: r for r in QUERIES["op7_quality_rules"](spark, sf).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        _, features = statistics((text or "").encode())
        total = forest.base
        for feature, threshold, value in zip(forest.feature.tolist(), forest.threshold.tolist(), forest.value.tolist()):
            node = 0
            while node < inner:
                node = 2 * node + (2 if feature[node] >= 0 and features[feature[node]] > threshold[node] else 1)
            total += value[node - inner]
        score = 1 / (1 + np.exp(-total))
        assert abs(got[doc_id]["score"] - score) < 1e-9
        assert got[doc_id]["kept"] == (not base(text)[5] and score >= 0.5)
