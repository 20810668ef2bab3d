import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import passages
from tessera.llm.passages import common_prefixes, pieces, removed, repeats, rotations, segments, summary
from tessera.llm.queries import QUERIES


def hashed(text):
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64)) if text is not None else 42


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    seen, gone = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]))):
        data = (text or "").encode()
        cover = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                cover[i : i + 100] = True
            seen.add(data[i : i + 100])
        gone[doc_id, text] = cover
    out = []
    for doc_id, text in rows:
        data, cover = (text or "").encode(), gone[doc_id, text]
        kept = bytes(b for b, c in zip(data, cover) if not c)
        n_spans = int((cover[1:] < cover[:-1]).sum())
        out.append((doc_id, len(data), int(cover.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, summary(df).collect()), key=str)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(300)]
    line = lambda k: " ".join(rng.choices(words, k=k))
    shared = [line(40) for _ in range(6)] + ["ab" * 150, "x" * 400, "1234567" * 40]
    docs = []
    for d in range(n):
        parts = [line(rng.choice([0, 3, 30, 60]))]
        for _ in range(rng.choice([0, 1, 1, 3])):
            part = rng.choice(shared)
            a = rng.randrange(len(part) // 2)
            parts += [part[a : a + rng.choice([90, 130, 400])], line(rng.choice([0, 2, 20]))]
        docs.append((d, rng.choice(["", " "]).join(parts)))
    return docs + [(d + 1000, docs[d][1]) for d in range(0, 20, 3)] + [docs[4], (None, docs[5][1]), (7, shared[0])]


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    result = sorted(map(tuple, QUERIES["op10_suffix_dedup"](spark, sf).collect()), key=str)
    assert result == brute(docs) and sum(r[2] for r in result) > 1000


def test_planted_passages(spark):
    docs = made(1)
    frame = spark.createDataFrame([(d, t, "clash", "clash") for d, t in docs], "doc_id long, text string, anchor string, id string")
    assert got(frame) == brute(docs)
    for row in removed(frame).collect():
        assert row["n_bytes"] - sum(s["end"] - s["start"] for s in row["spans"]) == len(row["kept"])


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == brute(rows)
    assert summary(odd.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [1, 700, 10**9])
def test_settled_alike_whatever_is_hot(spark, monkeypatch, hot):
    """All anchors, some, or none through the windows' own bytes: the same verdicts."""
    docs = made(5, 40)
    monkeypatch.setattr(passages, "HOT", hot)
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_texts_under_one_id_are_told_apart(spark):
    """Texts whose hashes agree in their low 24 bits lose what they repeat themselves and no more."""
    rng, seen = random.Random(7), {}
    while True:
        text = "".join(rng.choices("abcdefghijklmnop ", k=420))
        if (other := seen.setdefault(hashed(text) & 0xFFFFFF, text)) != text:
            break
    text += text[100:300]
    docs = [(1, text), (1, other), (None, other), (None, text), (None, "x" * 300), (2, "x" * 300), (1, None), (1, "")]
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_anchors_with_one_segment_need_no_transform(monkeypatch):
    rng = random.Random(2)
    sizes = [1] * 40 + [3] + [1] * 7 + [2, 5] + [1]
    rows = []
    for anchor, n in enumerate(sizes):
        shared = rng.randbytes(128)
        for k in range(n):
            rows.append({"anchor": anchor, "name": b"%d.%d" % (anchor, k), "segment": bytes(b % 128 for b in shared) + b"!" * k, "id": None if k == 1 else k, "hash": 7, "place": passages.packed(9, 29 + k)})
    seen, whole = [], passages.repeats
    monkeypatch.setattr(passages, "repeats", lambda segment, *rest: seen.append(len(segment)) or whole(segment, *rest))
    for step in (1, 4, 1000):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + step], pa.schema([("anchor", pa.int64()), ("name", pa.binary()), ("segment", pa.binary()), ("id", pa.int64()), ("hash", pa.int64()), ("place", pa.int64())])) for i in range(0, len(rows), step)]
        seen.clear()
        out = {bytes(r["name"]): r["late"] for b in passages.settle(batches) for r in b.to_pylist()}
        assert len(out) == len(rows) and sum(seen) <= 11  # 3 + 2 + 5 and the last, which may go on
        for r in rows:
            anchor, k = map(int, r["name"].split(b"."))
            several = sizes[anchor] > 1
            # The null id (k = 1) comes first, and each later one adds a window.
            late = [] if not several or k == 1 else list(range(29 + max(0, k - 1)))
            assert out[r["name"]] == late, (anchor, k)


def test_prefixes_by_interval_expansion():
    rng = random.Random(9)
    for _ in range(30):
        text = bytes(rng.choices(b"abc", k=rng.randrange(2, 200)))
        text = text + text[: rng.randrange(60)] + bytes([255])
        data = np.frombuffer(text, np.uint8)
        order = rotations(data, 16)
        turned = [(text + text)[i : i + len(text)] for i in order]
        assert [t[:16] for t in turned] == sorted(t[:16] for t in turned)
        prefix = common_prefixes(data[order - 1], 16)
        for i in range(1, len(text)):
            same = next((k for k in range(16) if turned[i][k : k + 1] != turned[i - 1][k : k + 1]), -1)
            assert prefix[i] == same


def test_equal_windows_share_anchors():
    texts = [t.encode() for _, t in made(3) if t]
    seen = {}
    for data, owner, offset, starts, lengths in pieces(texts):
        part, window, count, anchor = segments(data, starts, lengths)
        for p, w, c, a in zip(part, window, count, anchor):
            for i in range(w + offset[p], w + offset[p] + c):
                assert seen.setdefault(texts[owner[p]][i : i + 100], a) == a
    assert len(seen) == len({t[i : i + 100] for t in texts for i in range(len(t) - 99)})
    one = np.array([1])
    assert repeats(pa.array([b"x" * 101], pa.binary()), one, one, np.array([passages.packed(5, 2)])).to_pylist() == [[1]]
