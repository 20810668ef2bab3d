import sentencepiece

from tessera.llm.queries import MODEL, QUERIES
from tessera.llm.token_counts import Counter, token_counts


def expected(rows, limit=4096):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = []
    for doc_id, text in rows:
        n = len(library.encode(text or ""))
        out.append((doc_id, len((text or "").encode()), n, n > limit))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op2_token_counts"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs.select("doc_id", "text").collect())


def test_odd_texts(spark, odd):
    got = token_counts(odd, MODEL, limit=10)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(odd.select("doc_id", "text").collect(), 10)


def test_empty_table(odd):
    assert token_counts(odd.limit(0), MODEL).collect() == []


def test_proven_pieces_are_single_tokens():
    counter = Counter(MODEL)
    assert len(counter.alone) > 10_000
    assert "the" in counter.alone and "thxq" not in counter.alone
