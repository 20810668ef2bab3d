import re
from itertools import permutations

import numpy as np
import pytest

from tessera.llm.filter_audit import filter_audit, masks, orders, survivors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failed(rows):
    """For each (id, text) the letters it fails, one document at a time."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t in rows),
        }
        out.append({x for x in fails if fails[x]})
    return out


def brute(rows, labels):
    """Every order played through on (id, text, part) rows."""
    fails = failed([(i, t) for i, t, _ in rows])
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    out = set()
    for part in {p or "" for _, _, p in rows}:
        own = [(i, fails[k]) for k, (i, _, p) in enumerate(rows) if (p or "") == part]
        found, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                redundant = sum(x in f for _, f in own) - len(gone)
                alone = sum(f == {x} for _, f in own)
                total[x] += len(gone)
                found.append((x, (part, "".join(order), step, len(left), len(gone), redundant, alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))))
        out |= {(*row, total[x]) for x, row in found}
    return out


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (6, 1, 1), (6, 1, 1), (8, 0, 0)]


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    docs = odd.withColumnsRenamed({"count": "mask", "n_words": "part"}).selectExpr("*", "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'x' ELSE '' END AS lang")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    got = [tuple(r) for r in filter_audit(docs, labels).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, LABELS)
    assert filter_audit(docs.limit(0), labels).collect() == []
    assert {tuple(r) for r in filter_audit(docs, labels.limit(0)).collect()} == brute(rows, [])


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    got = {tuple(r) for r in filter_audit(docs, labels).collect()}
    assert got == brute(rows, [tuple(r) for r in labels.collect()])


def test_copies_need_a_smaller_id(spark):
    docs = spark.createDataFrame([(5, "a", "x"), (5, "a", "y"), (7, "a", "x"), (None, "a", "x"), (None, None, None), (9, "", "x"), (10, None, "x")], "doc_id long, text string, lang string")
    got = sorted((str(r["id"]), r["mask"] >> 4) for r in masks(docs).collect())
    assert got == [("10", 1), ("5", 0), ("5", 0), ("7", 1), ("9", 0), ("None", 0), ("None", 0)]


@pytest.mark.parametrize("k", [1, 3, 5, 7])
def test_every_subset(k):
    rng = np.random.default_rng(k)
    mask = np.unique(rng.integers(0, 1 << k, 40))
    counts = rng.integers(0, 50, (len(mask), 3))
    states = survivors(mask, counts, k)
    for subset in range(1 << k):
        assert (states[subset] == counts[mask & subset == 0].sum(axis=0)).all()


def test_shapley_is_the_sum_over_orders():
    rng = np.random.default_rng(5)
    rows = orders(survivors(np.arange(8), rng.integers(0, 9, (8, 3)), 3), "xyz")
    for name in "xyz":
        removed = sum(r[3] for r in rows if r[0][r[1] - 1] == name)
        assert {r[8] for r in rows if r[0][r[1] - 1] == name} == {removed}
