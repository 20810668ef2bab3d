import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn
from tessera.llm.queries import QUERIES

SCHEMA = "id long, label string, v array<bigint>, score string, mark double"


def brute(rows, asks, positives=5, negatives=3, least=50, most=95):
    """Every pair scored; rows are (id, label, v) and take part as the docstring says."""
    distinct = {(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and None not in v and sum(x * x for x in v) < 2**62}
    out = []
    for a in distinct:
        if not asks(a[0]):
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))
        best = sorted(((-score(r), r[0]) for r in distinct if r != a and r[1] == a[1]))[:positives]
        for back, positive in best:
            fits = sorted((-score(r), r[0]) for r in distinct if r[1] != a[1] and least * -back <= 100 * score(r) <= most * -back)
            out += [(a[0], positive, rank, r, -back, -s) for rank, (s, r) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, asks=lambda i: i % 50 == 0, **options):
    df = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(df, asks(F.col("id")), **options).collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), str(i % 3), rng.integers(-40, 40, 9).tolist()) for i in range(160)]
    rows += [(None, "1", [1] * 9), (50, None, [1] * 9), (100, "1", None), (150, "1", [1, None, 2]), (300, "1", []), (350, "0", [7, -3]), (7, "1", [1] * 12)]
    rows += [(400, "9", [5] * 9), rows[0], rows[0], rows[51], (450, "2", [0] * 9), (500, "1", [2**31] * 2)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 50 == 0)
    assert mined(spark, rows, positives=2, negatives=4, least=0, most=100) == brute(rows, lambda i: i % 50 == 0, 2, 4, 0, 100)
    assert mined(spark, []) == []
    assert mined(spark, [(50, "1", [1, 2])]) == []


def test_ties_and_a_common_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], [10, 10, 0]) for i in range(120)] + [(i, "c", [8, 8, int(rng.integers(0, 2))]) for i in range(120, 400)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 50 == 0)


def test_large_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], rng.integers(0, 1 << 29, 6).tolist()) for i in range(200)]
    assert mined(spark, rows, lambda i: i % 20 == 0) == brute(rows, lambda i: i % 20 == 0)


def test_many_blocks_and_slices(spark, monkeypatch):
    for name, value in (("ANCHORS", 3), ("SLICE", 40), ("ROWS", 16), ("SIDE", 2), ("STEP", 2)):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 60, (6, 11))
    rows = [(i, str(i % 4), (middle[i % 6] + rng.normal(0, 25, 11)).astype(int).tolist()) for i in range(300)]
    assert mined(spark, rows, lambda i: i % 20 == 0) == brute(rows, lambda i: i % 20 == 0)


@pytest.mark.parametrize("kind", [np.float64, np.int64])
@pytest.mark.parametrize("share", [0.2, 0.6, 0.9, -1.0])
def test_index_finds_all_pairs_above_a_threshold(kind, share):
    rng = np.random.default_rng(5)
    falling = 2.0 ** -np.arange(40)[None] ** 0.5
    anchors, rows = ((rng.normal(0, 300, (n, 40)) * falling).astype(np.int64) for n in (30, 500))
    scores = anchors @ rows.T
    norm = np.sqrt((anchors.astype(float) ** 2).sum(axis=1).max())
    thresholds = (share * norm * np.sqrt((rows.astype(float) ** 2).sum(axis=1).max()) * rng.uniform(0.9, 1.1, 30)).astype(np.int64)
    wanted = rng.random(scores.shape) < 0.8
    index = hn.NormIndex(rows.astype(kind), norm, float(thresholds.min()))
    i, j, score = index.reach(anchors.astype(kind), thresholds, wanted)
    want = np.argwhere(wanted & (scores >= thresholds[:, None]))
    assert sorted(zip(i, j)) == sorted(map(tuple, want)) and (scores[i, j] == score).all()
    # What norms rule out is not listed at all.
    if share > 0:
        assert index.listed.mean() < index.steps
        assert (index.listed == 0).sum() > 0 or share < 0.9


def test_lower_thresholds_only_for_open_windows(spark, monkeypatch):
    asked = []
    whole = hn.joined
    monkeypatch.setattr(hn, "joined", lambda rows, wanted, n, anchors, *rest: asked.append(anchors) or whole(rows, wanted, n, anchors, *rest))
    sf = "/root/testdata/sf0.1"
    assert QUERIES["op13_hard_negatives"](spark, sf).count() == 600
    assert asked[0] == 40 and all(a >= b for a, b in zip(asked, asked[1:]) if b < 40) and sum(asked) < 6 * 40
