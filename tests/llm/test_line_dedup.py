import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm.line_dedup import line_dedup
from tessera.llm.queries import QUERIES


def brute(rows, least=6):
    """(doc_id, text after removal, lines removed, passages removed) of every row, line by line."""
    key = lambda r: (r[0] is not None, r[0] or 0, hash_of(r[1]))
    BEFORE.clear()
    seen, gone = set(), {}
    for row in sorted(set(rows), key=key):
        lines = (row[1] or "").encode().split(b"\n")
        solid = [i for i, line in enumerate(lines) if line.split()]
        flags = [False] * len(lines)
        for a, b in zip(solid, solid[1:]):
            if (lines[a], lines[b]) in seen:
                flags[a : b + 1] = [True] * (b + 1 - a)
            seen.add((lines[a], lines[b]))
        # Neighbouring removed pairs that share no line are passages of their own.
        cuts = {b for a, b in zip(solid, solid[1:]) if flags[a] and flags[b] and (lines[a], lines[b]) not in seen_before(rows, row, key)}
        runs, start = [], None
        for i in range(len(lines) + 1):
            if start is not None and (i == len(lines) or not flags[i] or i in cuts):
                end = i
                while end > start and not lines[end - 1].split():
                    end -= 1
                runs.append((start, end))
                start = None
            if i < len(lines) and flags[i] and start is None and lines[i].split():
                start = i
        gone[row] = [(a, b) for a, b in runs if sum(len(x.split()) for x in lines[a:b]) >= least]
    out = []
    for row in rows:
        lines = (row[1] or "").encode().split(b"\n")
        lost = {i for a, b in gone[row] for i in range(a, b)}
        kept = b"\n".join(x for i, x in enumerate(lines) if i not in lost).decode()
        out.append((row[0], (kept if lost else row[1]) if row[1] is not None else None, len(lost), len(gone[row])))
    return sorted(out, key=str)


def seen_before(rows, row, key):
    """The pairs of lines of all documents before ``row``, and those that it repeats itself."""
    if row not in BEFORE.setdefault(id(rows), {}):
        found, own = set(), BEFORE[id(rows)]
        for other in sorted(set(rows), key=key):
            lines = [x for x in (other[1] or "").encode().split(b"\n") if x.split()]
            pairs = Counter(zip(lines, lines[1:]))
            own[other] = {p for p in pairs if p in found or pairs[p] > 1}
            found |= set(pairs)
    return BEFORE[id(rows)][row]


BEFORE: dict = {}


def hash_of(text):
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64)) if text is not None else 42


def got(df, **options):
    rows = line_dedup(df, report=True, **options).collect()
    return sorted(((r["doc_id"], r["text"], r["_n_removed"], r["_n_chunks"]) for r in rows), key=str)


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [(d, len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), lost, gone) for d, t, lost, gone in brute(docs)]
    result = QUERIES["op3_line_dedup"](spark, sf).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["kept_sha256"], r["n_removed"], r["n_chunks"]) for r in result), key=str) == sorted(wanted, key=str)
    assert sum(r["n_removed"] for r in result) > 0


def test_nearly_all_repeated_bytes_are_found(spark):
    """Of the bytes in pairs of lines that occur in an earlier different text, at least 0.9 go."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = sorted((tuple(r) for r in docs.collect() if r["text"]), key=lambda r: r[0])
    kept = {r["doc_id"]: r["text"] for r in line_dedup(docs).collect()}
    seen, texts, repeated, lost = set(), set(), 0, 0
    for doc_id, text in rows:
        if text in texts:
            continue
        texts.add(text)
        lines, flags = text.split("\n"), Counter()
        for i, pair in enumerate(zip(lines, lines[1:])):
            if pair in seen:
                flags.update((i, i + 1))
        seen |= set(zip(lines, lines[1:]))
        repeated += sum(len(lines[i].encode()) for i in flags)
        lost += min(len(text.encode()) - len(kept[doc_id].encode()), sum(len(lines[i].encode()) + 1 for i in flags))
    print(f"{lost} of {repeated} bytes")
    assert repeated > 100_000 and lost >= 0.9 * repeated


def test_shifted_passages(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choices("abcdefgh", k=6)) + str(rng.random())
    passage = [line() for _ in range(60)]
    docs = []
    for d in range(40):
        lines = [line() for _ in range(rng.randrange(0, 25))]
        at = rng.randrange(len(lines) + 1)
        docs.append((d, "\n".join(lines[:at] + passage[d % 3 : 60 - d % 4] + lines[at:])))
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, digest string")
    result = got(frame)
    assert result == brute(docs)
    assert [r[2] for r in sorted(result)] == [0] + [60 - d % 3 - d % 4 for d in range(1, 40)]


def test_passages_of_two_lines(spark):
    docs = [
        (1, "one two three\nfour five six\nother"),
        (2, "new\none two three\n\n \nfour five six\nnew"),  # blank lines between go along
        (3, "one two three\nother"),  # a single line stays
        (4, "x\ny"),
        (5, "x\ny"),  # too few words
        (6, "a b c\na b c\na b c\na b c"),  # repeats itself
        (None, "four five six\nother"),
        (1, "one two three\nfour five six\nother"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(frame) == brute(docs)
    kept = {r["doc_id"]: r["text"] for r in line_dedup(frame).collect()}
    # The null id comes first, so its pair is a repeat in 1.
    assert (kept[2], kept[3], kept[5], kept[6], kept[None]) == ("new\nnew", "one two three\nother", "x\ny", "a b c", "four five six\nother")
    assert {r["doc_id"]: r["text"] for r in line_dedup(frame, least=2).collect()}[5] == ""


def test_lines_that_share_a_hash_stay(spark):
    docs = [(1, "one two three four\nfive six seven"), (2, "two one three four\nfive six seven"), (3, "a b c d\nz"), (4, "a b c d\nz")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in line_dedup(frame, least=1, hashed=len).collect()}
    assert kept == dict(docs[:3]) | {4: ""}


@pytest.mark.parametrize("least", [1, 6])
def test_odd_rows(spark, odd, least):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd, least=least) == brute(rows, least)
    out = line_dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup(odd.limit(0)).collect() == []
