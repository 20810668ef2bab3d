"""SentencePiece encoding and decoding by a Viterbi search batched in numpy.

A text becomes word starts and characters as the model file says (spaces are
word starts, one is put in front). No piece holds a word start after another
character or a line break, so the best segmentation of a text is that of its
words (a run of word starts, or a line break, with what follows), and each
distinct word is solved once per task.
Words of the same length advance together, one character a step: hashes of the
substrings that end there are looked up in the sorted hashes of all pieces,
hits are compared character by character, and the maximum over the beginnings
leaves a back pointer. Characters without a piece cost ten less than the worst
piece and are written as byte pieces.

The segmentation is the one with the largest sum of piece scores; on ties the
longer last piece wins. Sums are exact, so a text of any length has one result.

Defined results: null and empty texts have no ids; ids decode to exactly the
text (word starts in a text come back as spaces, as the format has it); rows
are kept one to one.
"""
from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.texts import batch_of, per_portion, raw

START = "▁"
#: Words: a run of word starts, or a line break, with what follows.
WORDS = re.compile("▁+[^▁\n]*|\n[^▁\n]*")
#: Distinct words a task remembers; what is dropped is solved again.
CACHED = 400_000
#: Characters of words solved together at most.
TOGETHER = 1 << 19


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class Pieces:
    """The pieces of a model file, searchable by hash."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, model: str):
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = library.get_piece_size()
        self.texts = [library.id_to_piece(i) for i in range(n)]
        self.bytes_at = {int(self.texts[i][3:5], 16): i for i in range(n) if library.is_byte(i)}
        if len(self.bytes_at) != 256:
            raise ValueError("the model has no piece for every byte")
        normal = [
            i for i in range(n)
            if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)) and self.texts[i]
        ]
        if any(START in self.texts[i].lstrip(START) or "\n" in self.texts[i] for i in normal):
            raise ValueError("a piece crosses a word start or a line break, so words cannot be solved alone")
        self.longest = max(len(self.texts[i]) for i in normal)
        chars = np.zeros((len(normal), self.longest), np.uint64)
        for row, i in enumerate(normal):
            points = code_points(self.texts[i])
            chars[row, : len(points)] = points
        lengths = np.array([len(self.texts[i]) for i in normal])
        hashes = np.zeros(len(normal), np.uint64)
        for at in range(self.longest):
            hashes = np.where(at < lengths, self.step(hashes, chars[:, at]), hashes)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        order = np.argsort(hashes)
        self.keys, self.chars, self.lengths = hashes[order], chars[order], lengths[order]
        self.ids = np.array(normal)[order]
        self.scores = np.array([library.get_score(i) for i in normal], float)[order]
        self.unknown = self.scores[self.scores > -1e8].min() - 10.0
        control = {i for i in range(n) if library.is_control(i) or library.is_unknown(i)}
        plain = [b"" if i in control else self.texts[i].replace(START, " ").encode() for i in range(n)]
        for byte, i in self.bytes_at.items():
            plain[i] = bytes([byte])
        self.plain = plain

    @classmethod
    def step(cls, hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (hashes + chars + np.uint64(1)) * cls.BASE

    def find(self, hashes: np.ndarray, words: np.ndarray, begin: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``words`` whose characters from ``begin`` on are a piece of ``size``, and the place of the piece."""
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        rows = np.flatnonzero((self.keys[place] == hashes) & (self.lengths[place] == size))
        place = place[rows]
        equal = (self.chars[place, :size] == words[rows, begin : begin + size]).all(axis=1)
        return rows[equal], place[equal]

    def solve(self, words: np.ndarray) -> list[np.ndarray]:
        """The ids of words of equal length (a row each, as code points)."""
        count, length = words.shape
        best = np.full((length + 1, count), -np.inf)
        best[0] = 0.0
        back = np.zeros((length + 1, count), np.int32)
        piece = np.full((length + 1, count), -1, np.int32)  # -1: the character as bytes
        hashes = np.zeros((self.longest, count), np.uint64)  # of what begins so many characters before
        for end in range(1, length + 1):
            # The beginnings of all substrings that end here move on by one character.
            hashes[1:] = hashes[:-1].copy()
            hashes[0] = 0
            live = min(end, self.longest)
            hashes[:live] = self.step(hashes[:live], words[:, end - 1])
            for size in range(live, 0, -1):  # the longest first: it stays on ties
                rows, place = self.find(hashes[size - 1], words, end - size, size)
                score = best[end - size, rows] + self.scores[place]
                better = score > best[end, rows]
                rows, place = rows[better], place[better]
                best[end, rows], back[end, rows], piece[end, rows] = score[better], end - size, place
                if size == 1:
                    known = np.zeros(count, bool)
                    known[self.find(hashes[0], words, end - 1, 1)[0]] = True
                    rows = np.flatnonzero(~known & (best[end - 1] + self.unknown > best[end]))
                    best[end, rows], back[end, rows], piece[end, rows] = best[end - 1, rows] + self.unknown, end - 1, -1
        out: list[list[int]] = [[] for _ in range(count)]
        at = np.full(count, length)
        while (rows := np.flatnonzero(at > 0)).size:  # back along the pointers, all words together
            found = piece[at[rows], rows]
            for row, p, e in zip(rows.tolist(), found.tolist(), at[rows].tolist()):
                if p >= 0:
                    out[row].append(int(self.ids[p]))
                else:
                    out[row].extend(self.bytes_at[b] for b in reversed(chr(int(words[row, e - 1])).encode()))
            at[rows] = back[at[rows], rows]
        return [np.array(ids[::-1], np.int32) for ids in out]


class Codec:
    """Encodes and decodes with a bounded memory of words."""

    def __init__(self, model: str):
        self.pieces = Pieces(model)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        return WORDS.findall(START + text.replace(" ", START)) if text else []

    def learn(self, words: set[str]) -> None:
        if len(self.known) > CACHED:
            self.known.clear()
        by_length: dict[int, list[str]] = {}
        for word in words - self.known.keys():
            by_length.setdefault(len(word), []).append(word)
        for length, group in by_length.items():
            width = max(1, TOGETHER // length)
            for start in range(0, len(group), width):
                part = group[start : start + width]
                solved = self.pieces.solve(code_points("".join(part)).reshape(len(part), length))
                self.known.update((word, ids.tobytes()) for word, ids in zip(part, solved))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(x) for x in texts]
        self.learn(set().union(*split))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of a text; ids out of range are an error, control ids are nothing."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.pieces.plain):
            raise ValueError("an id is not in the vocabulary")
        return b"".join(map(self.pieces.plain.__getitem__, ids.tolist())).removeprefix(b" ")


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def same(coder: Codec, ids: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Whether ids decode to the texts, word starts being spaces."""
    space = START.encode()
    return np.array([coder.decode(i) == x.replace(space, b" ") for i, x in zip(ids, texts)], bool)


def encode(docs: DataFrame, model: str, text: str = "text", into: str = "token_ids", checked: str | None = None) -> DataFrame:
    """``docs`` with the ids of column ``text`` in the new (or replaced) column ``into``; all other columns stay.

    ``checked`` names a further column that tells whether the ids decode to the text.
    """
    new = [into] if checked is None else [into, checked]
    kept = [c for c in docs.columns if c not in new]
    schema = T.StructType([*docs.select(kept).schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])
    if checked is not None:
        schema.add(checked, T.BooleanType())

    def work():
        coder = codec(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = raw(batch, text)
            ids = coder.encode([x.decode() for x in texts])
            columns = [lists(ids)] if checked is None else [lists(ids), pa.array(same(coder, ids, texts))]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

        return step

    return per_portion(docs.select(kept), schema, work, column=text)


def decode(coded: DataFrame, model: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``coded`` with the text of the ids; null ids are empty, bytes that are no UTF-8 become U+FFFD."""
    kept = [c for c in coded.columns if c != into]
    schema = coded.select(kept).schema.add(into, T.StringType())

    def run(batches):
        coder = codec(model)
        for batch in batches:
            rows = [np.array(x if x is not None else [], np.int64) for x in batch.column(ids).to_pylist()]
            texts = [coder.decode(x).decode(errors="replace") for x in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, into])

    return coded.select(kept).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_ids, ids_hash, same``: a digest of the ids and whether they decode to the text.

    ``ids_hash`` is the XXH64 of the ids as 32-bit little-endian numbers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work():
        coder = codec(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = raw(batch, "text")
            coded = coder.encode([x.decode() for x in texts])
            return batch_of(
                doc_id=batch.column("doc_id"),
                n_ids=np.array([len(x) for x in coded], np.int64),
                ids_hash=pa.array([xxhash.xxh64_hexdigest(x.tobytes()) for x in coded], pa.string()),
                same=same(coder, coded, texts),
            )

        return step

    return per_portion(docs.select("doc_id", "text"), f"doc_id {kind}, n_ids bigint, ids_hash string, same boolean", work)
