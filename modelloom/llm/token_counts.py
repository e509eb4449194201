"""Token counts of a byte-level BPE by rank-synchronous merging of arrays.

Texts are cut at blanks into runs whose tokens do not depend on each other. Runs that a
task has not seen yet are split into pre-tokens, which are held as one ragged array of
symbols. In every round each pre-token merges its pair of lowest rank, all of them at
once; the symbols that are left when no pair has a rank are its tokens.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from modelloom.llm.common import with_text_columns

VOCABULARY = "byte_bpe_50k.json"
#: Runs remembered by a worker, length of a remembered run.
CACHED, CACHED_CHARS = 120_000, 40
NEVER = np.int64(1 << 60)

# The public pattern of this vocabulary's pre-tokens: a fixed value.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters on whose classes all versions of Unicode agree; for runs with others the
#: tokenizer library's own splitter is asked.
PLAIN = re.compile(r"[\n\t\r\x20-\x7e\xa1-ſ]*\Z")
SPACE_RUN = re.compile(r" (?=\s)| \Z")
WORD_START = re.compile(r" (?=\S)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in printable else spare))
        spare += b not in printable
    return letters


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class MergeTable:
    """Merges of a byte-level vocabulary, and the special strings that are one token each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocabulary, merges = data["model"]["vocab"], data["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.letters = byte_letters()
        self.to_byte = {c: b for b, c in enumerate(self.letters)}
        self.first = np.array([vocabulary[c] for c in self.letters], dtype=np.int64)
        self.size = np.int64(max(vocabulary.values()) + 1)
        left, right = (np.array([vocabulary[m[i]] for m in merges], dtype=np.int64) for i in (0, 1))
        made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(left * self.size + right)
        self.keys, self.ranks, self.made = (left * self.size + right)[order], order, made
        # A merge whose result is part of an earlier merge is applied once in a round only.
        earliest = np.full(self.size, len(merges), dtype=np.int64)
        np.minimum.at(earliest, left, np.arange(len(merges)))
        np.minimum.at(earliest, right, np.arange(len(merges)))
        self.single = earliest[made] < np.arange(len(merges))
        specials = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def pre_tokens(self, run: str) -> list[bytes]:
        if PLAIN.match(run):
            return [t.encode() for t in PRE_TOKEN.findall(run)]
        return [bytes(map(self.to_byte.__getitem__, t)) for t, _ in self.splitter.pre_tokenize_str(run)]

    def surviving(self, pre_tokens: list[bytes]) -> np.ndarray:
        """How many symbols are left of each pre-token after all merges."""
        lengths = np.array([len(t) for t in pre_tokens], dtype=np.int64)
        result = lengths.copy()
        symbol = self.first[np.frombuffer(b"".join(pre_tokens), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbol), NEVER)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.pair_ranks(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbol)])
            result[owner[starts]] = counts
            going = np.repeat(lowest < NEVER, counts)
            symbol, owner, rank = symbol[going], owner[going], rank[going]
            if not len(symbol):
                break
            lowest, counts = lowest[lowest < NEVER], counts[lowest < NEVER]
            starts = np.cumsum(counts) - counts
            hit = np.flatnonzero(rank == np.repeat(lowest, counts))
            # Of neighbouring hits, as in "aaa", every other one counts, from the left.
            begins = np.flatnonzero(np.r_[True, np.diff(hit) > 1])
            place = np.arange(len(hit)) - np.repeat(begins, np.diff(np.r_[begins, len(hit)]))
            alone = np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]
            hit = hit[(place % 2 == 0) & (alone | ~self.single[rank[hit]])]
            symbol[hit] = self.made[rank[hit]]
            stays = np.ones(len(symbol), dtype=bool)
            stays[hit + 1] = False
            # Ranks change for merged symbols and for those before them.
            changed = np.zeros(len(symbol), dtype=bool)
            changed[hit] = True
            symbol, owner, rank, changed = symbol[stays], owner[stays], rank[stays], changed[stays]
            changed[:-1] |= changed[1:]
            (at,) = np.nonzero(changed)
            rank[at] = NEVER
            at = at[at < len(symbol) - 1]
            at = at[owner[at] == owner[at + 1]]
            rank[at] = self.pair_ranks(symbol[at], symbol[at + 1])
        return result

    def sums(self, runs: list[str]) -> list[int]:
        """Tokens of each run; equal pre-tokens are merged once."""
        parts = [self.pre_tokens(r) for r in runs]
        distinct = {t: i for i, t in enumerate(dict.fromkeys(t for p in parts for t in p))}
        counts = self.surviving(list(distinct)) if distinct else None
        return [sum(int(counts[distinct[t]]) for t in p) for p in parts]


class TokenCounter:
    """Token counts of texts. A task remembers the runs that it has seen, at a text's start and after a blank."""

    def __init__(self, table: MergeTable):
        self.table, self.plain, self.spaced = table, {"": 0}, {}

    def runs(self, text: str) -> list[str]:
        """Parts of ``text`` to be tokenised alone; all but the first had a blank before them."""
        return WORD_START.split(text) if SPACE_RUN.search(text) else text.split(" ")

    def learn(self, known: dict[str, int], runs: set[str], before: str) -> list[str]:
        new = list(runs.difference(known))
        known.update(zip(new, self.table.sums([before + r for r in new]), strict=True))
        return [r for r in new if len(r) > CACHED_CHARS]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text, special strings in it being one each."""
        special = self.table.special
        segments = [(special.split(t) if special else [t]) if t else [] for t in texts]
        runs = [[self.runs(s) for s in parts] for parts in segments]
        if len(self.plain) + len(self.spaced) > CACHED:
            self.plain, self.spaced = {"": 0}, {}
        long = self.learn(self.plain, {r[0] for parts in runs for r in parts}, "")
        long_spaced = self.learn(self.spaced, set().union(*(r[1:] for parts in runs for r in parts)), " ")
        totals = []
        for parts in runs:
            total = max(0, len(parts) - 1)
            for r in parts:
                total += self.plain[r[0]] + sum(map(self.spaced.__getitem__, r[1:]))
            totals.append(total)
        for known, over in ((self.plain, long), (self.spaced, long_spaced)):
            for run in over:
                del known[run]
        return totals


def count_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None, limit: int = 512) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row's whole text.

    Null and empty texts have no bytes and no tokens. No special tokens are added; their
    strings within texts are one token each. Equal rows get equal counts. Kept columns with
    these names give way. ``path`` is a vocabulary file that all executors can read, by
    default the public byte-level one.
    """

    def compute():
        place = path
        if place is None:
            import public_tokenizers

            place = public_tokenizers.path(VOCABULARY)
        counter = TokenCounter(merge_table(place))

        def count(texts):
            tokens = counter.count(texts)
            return [len((t or "").encode()) for t in texts], tokens, [n > limit for n in tokens]

        return count

    return with_text_columns(docs, text_col, compute, "n_bytes long, n_tokens long, over_limit boolean", keep)
