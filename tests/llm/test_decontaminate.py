import random
import re
from collections import Counter

import pytest

from tessera.llm.decontaminate import SHINGLE, anchors_of, around_anchors, candidates, clean, decontaminate, items_of
from tessera.llm.queries import QUERIES


def split(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def bag(words, k):
    return Counter(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    """(doc_id, item_id): similarity of the best window, its start, and how many reach 0.8."""
    out = {}
    for doc_id, text in set(docs):
        words = split(text)
        for item_id, item in set(items):
            wanted = split(item)
            n, k = len(wanted), min(5, len(wanted))
            if not wanted or len(words) < k:
                continue
            b = bag(wanted, k)
            if not b.keys() & bag(words, k).keys():
                continue
            for start in range(max(1, len(words) - n + 1)):
                a = bag(words[start : start + n], k)
                s = (a & b).total() / (a | b).total()
                if s >= 0.8:
                    best, at, count = out.get((doc_id, item_id), (0, 0, 0))
                    out[doc_id, item_id] = (*max((best, at), (s, -start)), count + 1)
    return {key: (pytest.approx(s), -at, c) for key, (s, at, c) in out.items()}


def found(df):
    return {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"], r["n_windows"]) for r in df.collect()}


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, item_id string, n int"),
        spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string"),
    )


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = found(QUERIES["op1_decontamination"](spark, sf))
    wanted = brute(docs, items)
    assert got == wanted and got


def test_edited_copies(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 4, 5, 9, 30, 30, 60, 120])))) for i in range(14)]
    items += [(50, "la " * 40), (51, "one two three " * 20), (52, items[5][1]), (53, None), (54, " \n"), (2, items[2][1])]
    docs = []
    for d in range(60):
        words = rng.choices(vocabulary, k=rng.choice([0, 2, 20, 80]))
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            copy = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["new"], ["other", "words"]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy[rng.choice([0, 0, 2]) :]
        docs.append((d, rng.choice([" ", "\n", "  \t"]).join(words).upper()))
    docs += [(3, docs[3][1]), (200, None), (201, ""), (202, " ".join(items[4][1].split()[:-1])), (None, items[4][1])]
    documents, benchmark = frames(spark, docs, items)
    got, wanted = found(decontaminate(documents, benchmark)), brute(docs, items)
    assert got.keys() == wanted.keys()
    assert got == wanted and len(got) > 30
    kept = clean(documents, benchmark)
    assert kept.columns == documents.columns
    hit = {d for d, _ in wanted}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in hit)


def test_empty_tables(spark):
    documents, benchmark = frames(spark, [(1, "a b c d e f g")], [(1, "a b c d e f g")])
    assert decontaminate(documents.limit(0), benchmark).collect() == []
    assert decontaminate(documents, benchmark.limit(0)).collect() == []
    assert clean(documents, benchmark.limit(0)).count() == 1
    assert found(decontaminate(documents, benchmark)) == {(1, 1): (1.0, 0, 1)}


def test_plan_is_native(spark, sf):
    plan = QUERIES["op1_decontamination"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_windows_meet_only_items_whose_anchor_they_hold(spark):
    """Thousands of items of one length that begin alike: a window is compared with the few it may reach."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    begin = "which of the following statements is true"
    items = [(i, begin + " " + " ".join(word() for _ in range(23))) for i in range(5000)]
    docs = [(d, " ".join(word() for _ in range(40)) + " " + begin + " " + " ".join(word() for _ in range(40))) for d in range(200)]
    docs += [(1000 + d, docs[d][1] + " " + items[7 * d][1] + " " + docs[d + 50][1]) for d in range(100)]
    documents, benchmark = frames(spark, docs, items)
    texts, _ = items_of(benchmark)
    pairs = candidates(around_anchors(documents, anchors_of(texts), [SHINGLE])).count()
    # 100 copies, each met by some 50 windows around it; the common beginning is no anchor.
    assert 100 <= pairs < 100 * 60
    got = found(decontaminate(documents, benchmark))
    assert {(d, i) for d, i in got} == {(1000 + d, 7 * d) for d in range(100)} and all(s == 1.0 for s, _, _ in got.values())
