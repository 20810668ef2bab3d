"""Token counts through strings that are proven to encode as a single token.

The vocabulary is merged bottom up inside pre-tokens (a run of word starts and
what follows up to the next one). No piece holds a word start after another
character, so no merge crosses a pre-token and counts add up; this is checked
when the model is read. Pieces that encode alone as one token are proven
offline, by encoding each of them once; a pre-token among them counts as one
without any merging. Only the rest is merged, each distinct one once per task.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are
neither dropped nor merged, so repeated rows stay; other columns are ignored.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tessera.llm.texts import RUNS, batch_of, per_portion, raw

START = "▁"
#: Distinct pre-tokens a task remembers; what is dropped is counted again.
CACHED = 600_000


class Counter:
    """Counts the tokens of texts under one model file."""

    def __init__(self, model: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.model.get_piece_size()
        pieces = [
            self.model.id_to_piece(i)
            for i in range(size)
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))
        ]
        if any(START in piece.lstrip(START) for piece in pieces):
            raise ValueError("a piece crosses a word start, so counts of pre-tokens would not add up")
        if self.model.encode("a  b \n") == self.model.encode("a b"):
            raise ValueError("the model drops white space, which pre-tokens keep")
        #: A line break that no piece contains is a token of its own and separates what is around it.
        self.lines = not any("\n" in piece for piece in pieces)
        self.alone = self.proven(pieces)
        self.known: dict[str, int] = {}

    def proven(self, pieces: list[str]) -> frozenset[str]:
        """The pre-tokens, without their first word start, that are one token."""
        tails = [p[1:] for p in pieces if p.startswith(START) and p != START]
        encoded = self.model.encode([x.replace(START, " ") for x in tails], num_threads=1)
        return frozenset(tail for tail, ids in zip(tails, encoded) if len(ids) == 1) | {""}

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text, each without its first word start.

        One that begins with a line break follows it directly and has no word start.
        """
        if not text:
            return []
        joined = text.replace(" ", START)
        tails = (joined.replace("\n", "▁\n") if self.lines else joined).split(START)
        if "" in tails:  # a run of word starts is one pre-token with what follows
            tails = [run[1:] for run in RUNS.findall(START + joined)]
            return [x for tail in tails for x in (("", tail) if self.lines and tail[:1] == "\n" else (tail,))]
        return tails

    def learn(self, tails: set[str]) -> None:
        """Count pre-tokens not met before: directly where proven, merged where not."""
        if len(self.known) > CACHED:
            self.known.clear()
        new = tails - self.known.keys()
        direct = new & self.alone
        self.known.update(dict.fromkeys(direct, 1))
        rest = list(new - direct)
        encoded = self.model.encode([x.replace(START, " ") for x in rest], num_threads=1)
        # A leading line break is encoded behind a word start that is not there.
        self.known.update((x, len(ids) - (self.lines and x[0] == "\n")) for x, ids in zip(rest, encoded))

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pre_tokens(x) for x in texts]
        self.learn(set().union(*split))
        return [sum(map(self.known.__getitem__, tails)) for tails in split]


@lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    return Counter(model)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text; ``model`` is a file all executors have."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work():
        counts = counter(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = raw(batch, "text")
            tokens = np.array(counts.counts([x.decode() for x in texts]), np.int64)
            return batch_of(
                doc_id=batch.column("doc_id"),
                n_bytes=np.fromiter(map(len, texts), np.int64, len(texts)),
                n_tokens=tokens,
                over_limit=tokens > limit,
            )

        return step

    return per_portion(docs.select("doc_id", "text"), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", work)
