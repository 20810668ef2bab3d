"""URL rules and globs matched at once by a bit-parallel automaton.

Every rule becomes a glob over the canonical URL, a dot, the lower-cased host
and the path. All globs are packed one behind the other into the bits of a few
64-bit words. One Shift-And step moves every glob of every URL of a batch by one
byte: bits shift where the byte fits the next token, and stay where the token
before them is a star. Cost per byte is the number of words, not of rules. As many
URLs go side by side as keep their states within ``STATES`` bytes, whatever the
number of rules.

Defined results: a null URL, or one without ``://``, has an empty host and path,
which fits no rule; a host without a path has the path ``/`` for the globs of
``blocked`` (so both spellings are judged alike) and none for the rules; without a
fitting rule a URL is blocked if one of these globs fits it and allowed otherwise.
Rules of equal length that both fit are told apart by their order. Rows are kept
one to one, a repeated one as often as it comes; URLs of any length are matched
whole; an empty table has no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.texts import batch_of, per_portion, raw

#: Production rules: (verdict, host, path); fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Bytes of states that move side by side.
STATES = 16 << 20
#: Globs that a table of them may hold: the masks that each task makes have some 100 KB for 100 of them.
GLOBS = 20_000

#: Globs for hosts no rule speaks of: labels that sell, track or lure.
BLOCKED = (
    "*.adult-*/**",
    "*.casino-*/**",
    "*.spam-*/**",
    "*.cheap-*/**",
    "*.free-bets*/**",
    "*.ads-*/**",
    "**/wp-login**",
)


def literal(text: str) -> str:
    """``text`` as a glob that fits only itself."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


class Automaton:
    """``*`` fits a run without ``/``, ``**`` any run, ``?`` one byte but ``/``; a backslash takes the next byte as it is."""

    def __init__(self, globs: Sequence[str]):
        fits: list[np.ndarray] = []  # for each bit: the bytes that lead into it
        stays: list[np.ndarray] = []  # the bytes on which it stays set
        begins, self.ends = [], []
        everything, segment = np.ones(256, bool), np.arange(256) != ord("/")
        for glob in globs:
            begins.append(len(fits))
            fits.append(~everything)  # nothing enters the state before the first token
            stays.append(~everything)
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    stays[-1] = everything
                    i += 2
                    continue
                if data[i] == ord("*"):
                    stays[-1] = stays[-1] | segment
                    i += 1
                    continue
                if data[i] == ord("?"):
                    token = segment
                else:
                    if data[i] == ord("\\") and i + 1 < len(data):
                        i += 1
                    token = np.arange(256) == data[i]
                fits.append(token)
                stays.append(~everything)
                i += 1
            self.ends.append(len(fits) - 1)
        self.words = max(1, -(-len(fits) // 64))
        self.enter = self.packed(fits)
        self.stay = self.packed(stays)
        self.first = np.zeros(self.words, np.uint64)
        for bit in begins:
            self.first[bit // 64] |= np.uint64(1 << bit % 64)

    def packed(self, rows: list[np.ndarray]) -> np.ndarray:
        """For each byte value the bits of the states that take it."""
        out = np.zeros((256, self.words), np.uint64)
        for bit, takes in enumerate(rows):
            out[takes, bit // 64] |= np.uint64(1 << bit % 64)
        return out

    def match(self, urls: list[bytes]) -> np.ndarray:
        """A row for each URL, a column for each glob: whether it fits the whole URL."""
        together = max(1, STATES // (8 * self.words))
        parts = [self.matched(urls[i : i + together]) for i in range(0, len(urls), together)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.ends)), bool)

    def matched(self, urls: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-lengths, kind="stable")  # URLs that ended drop off the end
        flat = np.frombuffer(b"".join(urls), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        live = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        state = np.tile(self.first, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for at, n in enumerate(live):
            now = state[:n]
            byte = flat[starts[:n] + at]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.enter[byte]) | (now & self.stay[byte])
        out = np.empty((len(urls), len(self.ends)), bool)
        for column, bit in enumerate(self.ends):
            out[order, column] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return out


def parts(url):
    """Host and path expressions of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, capitals, capitals.lower()), path


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] | DataFrame = BLOCKED) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (page_id, url).

    ``blocked`` may be a table with a column ``glob``, of up to ``GLOBS`` globs.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    split = pages.select("page_id", F.col("url").cast("string").alias("_url"))
    host, path = parts(F.col("_url"))
    split = split.select("page_id", host.alias("host"), path.alias("path"))
    rootless = (F.col("path") == "") & (F.col("host") != "")
    path = F.when(rootless, F.lit("/")).otherwise(F.col("path"))
    split = split.withColumns({"rootless": rootless, "canonical": F.concat(F.lit("."), "host", path)})
    ranked = sorted(rules, key=lambda rule: -len(rule[1] + rule[2]))  # the longest first
    if isinstance(blocked, DataFrame):
        found = blocked.select(F.col("glob").cast("string").alias("glob")).where("glob <> ''").distinct().orderBy("glob").limit(GLOBS + 1)
        blocked = [row["glob"] for row in found.collect()]
        if len(blocked) > GLOBS:
            raise ValueError(f"more than {GLOBS} globs")

    def work():
        automaton = Automaton([f"*.{literal(host)}{literal(path)}**" for _, host, path in ranked] + list(blocked))
        names = pa.array([host + path for _, host, path in ranked] + [None], pa.string())
        n = len(ranked)
        rooted = np.array([path != "" for _, _, path in ranked], bool)
        verdicts = np.array([verdict for verdict, _, _ in ranked] + ["allow", "block"], object)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hit = automaton.match(raw(batch, "canonical"))
            bare = np.asarray(batch.column("rootless").to_numpy(zero_copy_only=False), bool)
            fits = hit[:, :n] & ~(bare[:, None] & rooted)  # a path that is not there begins with no rule's
            ruled = np.concatenate([fits, np.ones((len(hit), 1), bool)], axis=1).argmax(axis=1)
            own = n + hit[:, n:].any(axis=1)
            return batch_of(
                page_id=batch.column("page_id"),
                host=batch.column("host"),
                path=batch.column("path"),
                rule=names.take(pa.array(ruled)),
                verdict=pa.array(verdicts[np.where(ruled < n, ruled, own)], pa.string()),
            )

        return step

    schema = f"page_id {kind}, host string, path string, rule string, verdict string"
    return per_portion(split, schema, work, column="canonical")
