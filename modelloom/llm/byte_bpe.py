"""Byte-level BPE encoding by longest matches and backtracking, and decoding.

A text is split by the vocabulary's pattern. Within a piece, bytes stand as Latin-1
characters, so that one pass of an Aho-Corasick automaton gives the longest token from each
place. A row of tokens is what the merges would give exactly if every two neighbours are what
the merges give for the two alone; whether they are is looked up once a pair. The encoder
takes the longest match that fits its predecessor, falls back to shorter ones, and steps back
from places that lead nowhere, each of which it leaves once, so a piece takes linear time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from modelloom.functions import col
from modelloom.llm.common import list_array, with_text_columns

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers, twice as many at most, pairs, and the length of a remembered piece.
CACHED, CACHED_PAIRS, CACHED_CHARS = 400_000, 1_000_000, 40
#: Characters of a text that are split at a time.
SPLIT_CHARS = 1_000_000
#: A blank between two other characters begins a piece in any case.
SAFE_CUT = regex.compile(r"(?<=\S) (?=\S)")
NONE = -1
OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
LITTLE = np.dtype("<u4")


@lru_cache(maxsize=2)
def splitter_of(pattern: str) -> Splitter:
    return Splitter(pattern)


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    return Codec(path)


class Splitter:
    """Pieces of texts, with the character classes that tiktoken itself has.

    Versions of Unicode differ in their letters, digits and blanks. Where tiktoken's tables
    and those of the local pattern library do, a character is read as one of its class.
    """

    # One character of each class, alike in all versions of Unicode.
    STANDS_FOR = {r"\p{L}": "é", r"\p{N}": "²", r"\s": " ", "": "¡"}

    def __init__(self, pattern: str):
        import tiktoken

        self.find = regex.compile(pattern).findall
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        bytes_alone = {bytes([b]): b for b in range(256)}
        theirs, ours = {}, {}
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            encoding = tiktoken.Encoding(kind, pat_str=f"{kind}+", mergeable_ranks=bytes_alone, special_tokens={})
            theirs.update(dict.fromkeys(encoding.decode(encoding.encode_ordinary(every)), kind))
            ours.update(dict.fromkeys(regex.findall(kind, every), kind))
        self.odd = {c for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}
        self.read_as = {ord(c): self.STANDS_FOR[theirs.get(c, "")] for c in self.odd}

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.find(text)
        found, at = [], 0
        for read in self.find(text.translate(self.read_as)):
            found.append(text[at : at + len(read)])
            at += len(read)
        return found

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, of a bounded part of it at a time where it can be cut."""
        a = 0
        while len(text) - a > SPLIT_CHARS and (cut := SAFE_CUT.search(text, a + SPLIT_CHARS)):
            yield self.pieces(text[a : cut.start()])
            a = cut.start()
        yield self.pieces(text[a:] if a else text)


class Codec:
    """Encoder and decoder for a file of tokens and their ranks, which are their ids too."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"no token for the bytes {missing}")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.base = max(self.tokens) + 1
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                halves = self.last_merge(token)
                if halves is None:
                    continue  # No merges lead to it: it is only ever a whole piece.
                if max(halves) >= rank:
                    raise ValueError(f"token {rank} is older than its parts: these ranks are no order of merges")
                self.halves[rank] = halves
                self.made[halves[0] * self.base + halves[1]] = rank
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        for rank, token in self.tokens.items():
            heads = (token[:n].decode("latin-1") for n in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((self.automaton.get(h) for h in heads if h in self.automaton), NONE)
        self.lengths = {rank: len(token) for rank, token in self.tokens.items()}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two parts that plain merging of the token's bytes joins last; None if it never joins all."""
        parts, ranks = [token[i : i + 1] for i in range(len(token))], self.ranks
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                return None
            i = best[1]
            last = ranks[parts[i]], ranks[parts[i + 1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together gives just these two."""
        key = left * self.base + right
        fits = self.pairs.get(key)
        if fits is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            fits = self.pairs[key] = self.stay_apart(left, right)
        return fits

    def stay_apart(self, left: int, right: int) -> bool:
        """Undo the merges of both, the newest first; no merge across the seam may be older than the next one within."""
        newest = self.base
        while True:
            across = self.made.get(left * self.base + right, self.base)
            if across < newest:
                return False
            # The later merge of the two sides is the one to undo; of equal ones the right side's.
            split_left, split_right = self.halves.get(left), self.halves.get(right)
            if split_left is None and split_right is None:
                return True
            if split_right is None or (split_left is not None and left > right):
                newest, left = left, split_left[1]
            else:
                newest, right = right + 1, split_right[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest, lengths, pairs, base = [NONE] * len(piece), self.lengths, self.pairs, self.base
        # Ends only rise, so what is written last at a place is the longest token from there.
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[rank]] = rank
        alive = bytearray(b"\1") * (len(piece) + 1)
        taken: list[int] = []
        at, token, n = 0, longest[0], len(piece)
        while at < n:
            end = at + lengths[token]
            if not taken:
                fits = alive[end]
            elif alive[end] and (fits := pairs.get(taken[-1] * base + token)) is None:
                fits = self.neighbours(taken[-1], token)
            else:
                fits = alive[end] and fits
            if fits:
                taken.append(token)
                at = end
                token = longest[at] if at < n else NONE
                continue
            token = self.shorter[token]
            while token == NONE:
                # Nothing fits here after what was taken: never come back, try a shorter one before.
                alive[at] = 0
                token = taken.pop()
                at -= lengths[token]
                token = self.shorter[token]
        return taken

    def encode(self, pieces: Sequence[str]) -> bytes:
        """Ids of the pieces, one after another, as little-endian 32-bit integers."""
        if len(self.known) > CACHED:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = set(pieces).difference(known)
        for piece in new:
            known[piece] = before.get(piece) or np.array(self.encode_piece(piece.encode()), dtype=LITTLE).tobytes()
        ids = b"".join(map(known.__getitem__, pieces))
        for piece in new:
            if len(piece) > CACHED_CHARS:
                del known[piece]
        return ids

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path is not None and pattern is not None:
        return path, pattern
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN


def encode_documents(
    docs: DataFrame,
    text_col: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    outputs: Sequence[str] = ("ids", "n_tokens"),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Token ids of every row's whole text, and what is derived from them.

    ``outputs`` are of ``ids``, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers) and ``decoded_sha256`` (of the bytes that the ids decode to), both
    in lower-case hex. Null and empty texts have no ids. Strings of special tokens are ordinary
    text. Equal rows get equal ids; nothing is shuffled. Kept columns (all by default) with the
    names of outputs give way. ``path`` is a file of ranks that all executors can read and
    ``pattern`` splits the text before the merges; both have public defaults.
    """
    outputs = list(outputs)

    def compute():
        place, split_by = defaults(path, pattern)
        codec, splitter = codec_of(place), splitter_of(split_by)

        def encode(texts):
            found = {name: [] for name in outputs}
            for text in texts:
                parts = [codec.encode(pieces) for pieces in splitter.parts(text)] if text else []
                if "ids" in found:
                    found["ids"].append(np.frombuffer(b"".join(parts), dtype="<i4"))
                if "n_tokens" in found:
                    found["n_tokens"].append(sum(map(len, parts)) // LITTLE.itemsize)
                if "ids_sha256" in found:
                    found["ids_sha256"].append(sha256(parts))
                if "decoded_sha256" in found:
                    found["decoded_sha256"].append(sha256(codec.decode(np.frombuffer(p, dtype=LITTLE).tolist()) for p in parts))
            if "ids" in found:
                ids = found["ids"]
                found["ids"] = list_array(np.concatenate(ids) if ids else np.zeros(0, dtype="<i4"), [len(x) for x in ids])
            return list(found.values())

        return encode

    return with_text_columns(docs, text_col, compute, ", ".join(f"{name} {OUTPUTS[name]}" for name in outputs), keep)


def sha256(parts) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def decode_documents(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, text_col: str = "text") -> DataFrame:
    """``encoded`` with the text that the ids stand for, in place of a column of that name.

    Null ids decode to null and no ids to an empty text. Ids that cut a character give U+FFFD
    for its bytes; an id that the vocabulary lacks is an error.
    """
    kept = [c for c in encoded.columns if c.lower() != text_col.lower()]
    source = encoded.select(*map(col, kept), col(ids_col).cast("array<int>").alias("__ids"))
    schema = source.drop("__ids").schema.add(text_col, "string")

    def run(batches):
        place, _ = defaults(path, "")
        codec = codec_of(place)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids).decode("utf-8", "replace") for ids in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
