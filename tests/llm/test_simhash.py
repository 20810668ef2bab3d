import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.queries import QUERIES
from tessera.llm.simhash import GrayIndex, components, gray_rank, near_duplicates, one_of_each


def brute_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """Smallest id reachable, over all pairs."""
    prints = [(d, brute_print(t)) for d, t in rows]
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op5_simhash"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(docs)


def test_odd_rows(spark, odd):
    got = near_duplicates(odd).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(odd.select("doc_id", "text").collect())
    assert near_duplicates(odd.limit(0)).collect() == []


def cluster(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = centres[rng.integers(0, 12, n)]
    for _ in range(5):
        prints ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(np.concatenate([prints, rng.integers(0, 2**63, n, dtype=np.uint64), [np.uint64(0), ~np.uint64(0)]]))


def brute_labels(prints, group):
    label = np.arange(len(prints))
    close = (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3) & (group[:, None] == group[None, :])
    while True:
        low = np.where(close, label[None, :], len(label)).min(axis=1)
        if (low == label).all():
            return label
        label = low


@pytest.mark.parametrize("n", [1, 7, 60, 700])
def test_index_links_like_all_pairs(n):
    prints = cluster(n)
    group = np.sort(np.random.default_rng(1).integers(0, 3, len(prints)))
    order = np.lexsort((gray_rank(prints), group))
    prints = prints[order]
    got = GrayIndex(group, prints).linked()
    assert (got == brute_labels(prints, group)).all()


def test_hot_buckets_are_cut(spark, monkeypatch):
    prints = cluster(150)
    frame = spark.createDataFrame([(i, int(p)) for i, p in enumerate(prints.view(np.int64))], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", "fp"))
    got = {r["fingerprint"]: r["component_id"] for r in near_duplicates(frame, hot=4).collect()}
    wanted = brute_labels(prints, np.zeros(len(prints)))
    assert [got[f"{int(p):016x}"] for p in prints] == wanted.tolist()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (300, 200)] + [(500, i) for i in range(501, 540)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    wanted = {i: 0 for i in range(1, 41)} | {200: 100, 300: 100} | {i: 500 for i in range(501, 540)}
    assert got == wanted
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hash_is_the_engine_hash(spark):
    text = "The Quick brown"
    here = int(np.uint64(simhash.shingle_hashes(text.encode())[0]).view(np.int64))
    assert spark.range(1).select(F.xxhash64(F.lower(F.lit(text)))).first()[0] == here


def test_rows_without_an_id_link(spark, monkeypatch):
    rows = [(7, 0b0), (None, 0b111), (3, 0b111111), (None, 0xFF << 40), (4, 0xFF << 20), (4, 0x7F << 50)]  # 7 and 3 meet over the null id only
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", "fp"))
    got = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in near_duplicates(frame).collect()}
    assert [got[r] for r in rows] == [3, 3, 3, None, 4, 4]


def test_one_of_each_keeps_texts_that_share_an_id(spark):
    texts = [" ".join(f"{c}{i * i % 97}" for i in range(60)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[0]), (None, texts[0]), (None, texts[2]), (3, texts[3])]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, fp string")
    got = one_of_each(frame)
    assert got.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, texts[0]), (1, texts[1]), (None, texts[2]), (3, texts[3])], key=str)
