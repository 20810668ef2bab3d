import itertools
import math
import re
import zlib

import numpy as np
import pytest

from tessera.llm import line_quality as lq
from tessera.llm.queries import QUERIES
from tests.llm.conftest import ODD

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(text):
    """The statistics of the lines of one text, word by word."""
    out, seen, copies, full = [], set(), 0, 0
    for line in text.split(b"\n"):
        words = WORD.findall(line)
        solid = b"".join(words)
        n, size = max(len(words), 1), max(len(solid), 1)
        kind = lambda known: sum(c in known for c in solid) / size
        letters, digits, marks = bytes(range(65, 91)) + bytes(range(97, 123)), b"0123456789", b".,;:!?'\"()-"
        symbol = lambda c: c < 128 and c not in letters + digits + marks
        copy = bool(words) and line in seen
        seen.add(line)
        copies, full = copies + copy, full + bool(words)
        out.append(
            [
                math.log1p(len(solid)), math.log1p(len(words)), len(solid) / n, math.log1p(max(map(len, words), default=0)),
                kind(range(65, 91)), kind(digits), kind(marks), sum(map(symbol, solid)) / size, kind(range(128, 256)),
                bool(words) and words[-1][-1] in b".!?:", bool(words) and 65 <= words[0][0] <= 90,
                sum(a == b for a, b in zip(words, words[1:])) / n, (len(words) - len(set(words))) / n,
                sum(len(w) < 3 for w in words) / n, sum(len(w) > 16 for w in words) / n, sum(len(w) == 1 and symbol(w[0]) for w in words) / n, copy,
            ]
        )
    return [[*row, copies / max(full, 1)] for row in out]


@pytest.mark.parametrize("piece", [1, 64, 1 << 19])
def test_statistics(monkeypatch, piece):
    monkeypatch.setattr(lq, "PIECE", piece)
    texts = [(t or "").encode() for t in ODD] + [b"a\nb\na\n\na", b"same\n" * 5]
    got, size, lines = lq.line_statistics(texts)
    want = [row for t in texts for row in plain(t)]
    assert lines.tolist() == [t.count(b"\n") + 1 for t in texts]
    assert np.allclose(got, np.array(want, float), atol=1e-6)
    assert size.tolist() == [len(b"".join(WORD.findall(line))) for t in texts for line in t.split(b"\n")]


def enumerated(logits, follow):
    """Marginals of one chain from the weights of all its labellings."""
    n, good, pairs, total = len(logits), np.zeros(len(logits)), np.zeros((len(logits) - 1, 2, 2)), 0.0
    for states in itertools.product((0, 1), repeat=n):
        weight = math.exp(sum(x * s for x, s in zip(logits, states)) + sum(follow[a][b] for a, b in zip(states, states[1:])))
        total += weight
        good += weight * np.array(states)
        for i, (a, b) in enumerate(zip(states, states[1:])):
            pairs[i, a, b] += weight
    return good / total, pairs / total


def field(rng):
    k = len(lq.STATISTICS)
    return lq.Field(np.sort(rng.random((k, lq.BINS - 1)), axis=1), rng.normal(0, 0.5, (k * lq.BINS, 3)), 0.3, -0.2, 0.1, rng.normal(0, 1, (2, 2)))


def test_marginals_of_chains_side_by_side():
    rng = np.random.default_rng(3)
    f = field(rng)
    lines = [1, 7, 2, 1, 5, 9, 3]
    logits, begins = rng.normal(0, 3, sum(lines)), np.zeros(sum(lines), bool)
    begins[np.cumsum(lines) - lines] = True
    good, pairs = f.marginals(logits, begins, max(lines))
    at = 0
    for n in lines:
        one, two = enumerated(logits[at : at + n], f.follow)
        assert np.allclose(good[at : at + n], one) and np.allclose(pairs[at : at + n - 1], two)
        at += n


def test_score_line_by_line():
    """The score from plain statistics, sums over bins and messages passed one line at a time."""
    rng = np.random.default_rng(4)
    f = field(rng)
    texts = [b"One line.", b"", b"a b\n\nC d. 12\n| |", b"\n\n", b"x\n" * 3000]
    for text, score in zip(texts, f.score(texts)):
        rows = plain(text)
        bins = [[sum(np.float32(v) >= e for e in f.edges[i]) + i * lq.BINS for i, v in enumerate(r)] for r in rows]
        n = len(rows)
        logits = []
        for t in range(n):
            u = f.bias + sum(f.weight[b, 0] for b in bins[t]) + (f.first if t == 0 else 0) + (f.last if t == n - 1 else 0)
            u += sum(f.weight[b, 1] for b in bins[t - 1]) if t else 0
            u += sum(f.weight[b, 2] for b in bins[t + 1]) if t < n - 1 else 0
            logits.append(min(max(u, -30), 30))
        t = np.exp(f.follow)
        forward, backward = [np.array([1, math.exp(logits[0])])], [np.ones(2)]
        for u in logits[1:]:
            step = forward[-1] @ t * [1, math.exp(u)]
            forward.append(step / step.sum())
        for u in logits[:0:-1]:
            step = t @ (backward[-1] * [1, math.exp(u)])
            backward.append(step / step.sum())
        both = [a * b for a, b in zip(forward, backward[::-1])]
        good = [b[1] / b.sum() for b in both]
        size = [len(b"".join(WORD.findall(line))) for line in text.split(b"\n")]
        size = size if sum(size) else [1] * n
        assert score == pytest.approx(np.average(good, weights=size), abs=1e-9)
        assert f.score([text])[0] == pytest.approx(score, abs=1e-9)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op12_quality_classifier"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 500
    assert np.mean([p == 1 for p, y in held if y == 1]) > 0.97
    assert np.mean([p == 0 for p, y in held if y == 0]) > 0.9


def test_held_out_labels_change_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    one, two = ({(r["doc_id"], r["score"]) for r in lq.line_quality(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, "x"), (3, 0, "x"), (3, 0, "x"), (4, None, "x"), (None, 1, "x"), (8, 1, "y")], "doc_id long, quality int, text string")
    for known in (labels, labels.limit(0)):
        got = lq.line_quality(odd.withColumn("quality", odd["count"]), known).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.collect())
        assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got} == {0.5}
    assert lq.line_quality(odd.limit(0), labels).collect() == []
