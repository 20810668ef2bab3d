import random

import numpy as np
import pytest
import sentencepiece
import xxhash
from sentencepiece import sentencepiece_model_pb2 as proto

from tessera.llm.queries import MODEL, QUERIES
from tessera.llm.sentencepieces import Codec, decode, encode, round_trip


@pytest.fixture(scope="module")
def library():
    """The library's own search over the same pieces and scores."""
    model = proto.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for piece in model.pieces:  # the library adds up in 32 bits: -1e9 would drown the other scores
        piece.score = max(piece.score, -300_000.0)
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


@pytest.fixture(scope="module")
def coder():
    return Codec(MODEL)


def best_score(coder, text):
    """Score of the best segmentation, by plain dynamic programming over the whole text."""
    scores = {coder.pieces.texts[i]: s for i, s in zip(coder.pieces.ids.tolist(), coder.pieces.scores.tolist())}
    text = "▁" + text.replace(" ", "▁")
    best = [0.0]
    for end in range(1, len(text) + 1):
        options = [best[b] + scores[text[b:end]] for b in range(max(0, end - 16), end) if text[b:end] in scores]
        best.append(max(options) if text[end - 1] in scores else max([*options, best[end - 1] + coder.pieces.unknown]))
    return best[-1]


def score(coder, ids):
    by_id = dict(zip(coder.pieces.ids.tolist(), coder.pieces.scores.tolist()))
    total, pending = 0.0, b""
    for i in ids.tolist():
        if i in by_id:
            total += by_id[i]
        else:
            pending += coder.pieces.plain[i]
            try:
                pending.decode()
            except UnicodeDecodeError:
                continue
            total, pending = total + coder.pieces.unknown, b""
    return total


def test_like_the_library(spark, sf, library, coder):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    words = sorted({w for t in texts for w in t.split()})
    rng = random.Random(2)
    words += ["".join(rng.choices("aeinrst ▁#1é日\n", k=rng.randrange(1, 30))) for _ in range(500)]
    for word, ids in zip(words, coder.encode(words)):
        assert ids.tolist() == library.encode(word), word


def test_whole_texts_are_optimal(spark, sf, coder):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(25).collect()]
    texts += ["", " ", "  a   b ", "\n\n", "日本語☃ x", "x" * 300, "▁▁ a", "\x00\t"]
    for text, ids in zip(texts, coder.encode(texts)):
        assert not text or score(coder, ids) == best_score(coder, text)
        assert coder.decode(ids).decode() == text.replace("▁", " ")


def test_whole_table(spark, sf, coder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op8_sentencepiece"](spark, sf).collect()
    assert len(got) == len(texts) and all(r["same"] for r in got)
    for row in got:
        ids = coder.encode([texts[row["doc_id"]]])[0]
        assert (row["n_ids"], row["ids_hash"]) == (len(ids), xxhash.xxh64_hexdigest(ids.tobytes()))


def test_odd_rows(spark, odd):
    coded = encode(odd, MODEL)
    assert coded.columns == [*odd.columns, "token_ids"]
    back = decode(coded, MODEL).collect()
    assert len(back) == odd.count()
    for row in back:
        assert row["decoded"] == (row["text"] or "").replace("▁", " ")
        assert bool(row["token_ids"]) == bool(row["text"])
    assert all(r["same"] for r in round_trip(odd, MODEL).collect())
    assert round_trip(odd.limit(0), MODEL).collect() == []
    again = encode(coded.withColumnRenamed("text", "body"), MODEL, text="body")
    assert sorted(map(str, again.select("doc_id", "token_ids").collect())) == sorted(map(str, coded.select("doc_id", "token_ids").collect()))


def test_bad_ids(coder):
    with pytest.raises(ValueError):
        coder.decode(np.array([32_000]))
    assert coder.decode(np.array([], int)) == b"" == coder.decode(np.array([1, 2]))
