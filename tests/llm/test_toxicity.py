import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.queries import QUERIES
from tessera.llm.toxicity import bag, subwords, toxicity, train, words_of


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for doc_id, row in got.items():
        assert row["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert row["predicted"] == int(row["score"] >= 0.5) and 0 <= row["score"] <= 1
    held = [d for d in labels if got[d]["held_out"]]
    toxic = [got[d]["score"] for d in held if labels[d]]
    clean = [got[d]["score"] for d in held if not labels[d]]
    above = np.mean([[t > c for c in clean] for t in toxic])
    assert above > 0.8 and np.mean([c < 0.5 for c in clean]) > 0.9


def test_labels_and_source_are_no_inputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("toxic"))
    assert sorted(toxicity(docs, labels).collect()) == sorted(toxicity(changed, other).collect())


def test_misspellings_share_vectors():
    rng = random.Random(4)
    plain = ["".join(rng.choice(["ra", "lo", "ti", "men", "sa"]) for _ in range(3)) for _ in range(300)]
    texts = [" ".join(rng.choices(plain, k=60) + (["horridword"] * 3 if i % 3 == 0 else [])).encode() for i in range(300)]
    model = train(texts, np.array([i % 3 == 0 for i in range(300)]))

    def score(text):
        worth = model.worth(words_of(text.encode())).sum()
        return model.score(np.array([worth.real / worth.imag]))[0]

    clean = " ".join(rng.choices(plain, k=60))
    assert score(clean) < 0.5 < score(clean + " horridword" * 3)
    assert score(clean) < 0.5 < score(clean + " horrridwordd" * 4)


def test_subwords_are_those_of_each_word_alone():
    words = [b"a", b"abc", "größe".encode(), b"x" * 400]
    ids, counts = subwords(words)
    alone = [subwords([w])[0] for w in words]
    assert counts.tolist() == [len(x) for x in alone]
    assert [sorted(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [sorted(x) for x in alone]
    assert bag(b"")[0].size == 0 and np.isclose(bag(b"one two two")[1].sum(), 1)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, 1, "x"), (3, None, "x"), (None, 1, "x"), (99, 0, "x"), (4, 0, "x")], "doc_id long, toxic int, text string")
    got = toxicity(odd, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity(odd.limit(0), labels).collect() == []
    assert len({r["score"] for r in toxicity(odd, labels.limit(0)).collect()}) == 1


def test_scores_subword_by_subword(spark, sf):
    """Every score worked out a second way: one n-gram after the other, in whole numbers and a plain mean."""
    from tessera.llm.toxicity import learn, scored

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = learn(docs, labels)
    base, mix, full, known = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 2**64, {}
    apart = set(b"!\"#%&()+,./:;<=>?[\\]^`{|}~")

    def bucket(h):
        return ((h ^ (h >> 31)) * mix % full) >> 47

    def worth(word):
        if word not in known:
            marked = b"\x02" + word + b"\x03"
            ids = [bucket(sum(b * pow(base, k + 1, full) for k, b in enumerate(marked)) % full)]
            for n in (3, 4, 5):
                for i in range(len(marked) - n + 1):
                    h = 0
                    for k, b in enumerate(marked[i : i + n], 1):
                        h = (h * base + b + k) % full
                    ids.append(bucket(h))
            known[word] = (sum(model.table[i] for i in ids), len(ids))
        return known[word]

    for row in scored(docs.select("doc_id", "text"), model).collect():
        text = bytes(32 if b in apart else b + 32 if 65 <= b <= 90 else b for b in (row["text"] or "").encode())
        parts = [worth(w) for w in text.split()]
        mean = sum(x for x, _ in parts) / max(1, sum(n for _, n in parts))
        assert abs(row["score"] - 1 / (1 + np.exp(-(mean + model.bias)))) < 1e-9
