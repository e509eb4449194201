"""Packing tokenised documents into windows of fixed length, with minimum bin slack.

A document's full windows stand alone. What remains of it is shorter than a window; the
remainders are dealt into groups of bounded size. Within a group, the longest remainder
opens a window, and a subset-sum over the multiset of remaining lengths, kept as bits of
an integer, finds the lengths that fill the window closest to its capacity; the counts are
traced back, and the same window is repeated as often as they last.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelloom.functions import col
from modelloom.llm.common import checkpointed, in_parts, list_array, partitions_for
from modelloom.llm.token_counts import byte_letters

TOKENIZER = "word_bpe_49k.json"
#: Remainders of a group, runs of text that a worker remembers, twice as many at most, length of a remembered run.
GROUP, CACHED, CACHED_CHARS = 20_000, 250_000, 40
#: What strings of special tokens begin with; they count in their own case only.
SPECIAL = "<|"
#: Texts of characters whose lower case is one character, and which all versions of Unicode class alike.
PLAIN = re.compile(r"[\n\t\r\x20-\x7e\xa1-\u012f\u0131-\u017f\u2010-\u2027\u20ac]*\Z").match
#: Such letters only.
LETTERS = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+\Z").match
#: How the vocabulary spells the bytes of a word.
BYTE_LETTERS = dict(enumerate(byte_letters()))
#: A letter or digit after which commas and full stops are tokens of their own.
PLAIN_END = re.compile(r"(?s).*[A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]\Z").match


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class TokenBytes(dict):
    """From a run of text between blanks to its token ids, as little-endian 32-bit integers.

    The tokenizer drops white space and no token spans it, so a text's ids are those of
    its runs, one after another; nor does one span the end of a plain word and the commas or
    full stops after it. Case is dropped too, so plain texts are put in lower case at once. A
    worker remembers the runs that it has seen, and those seen lately when there are too many.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = tokenizer_of(path)
        self.merge = self.tokenizer.model.tokenize
        self.before: dict[str, bytes] = {}

    def of(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > CACHED:
            self.before = dict(self)
            self.clear()
        return [b"".join(map(self.__getitem__, self.runs(t))) if t else b"" for t in texts]

    def runs(self, text: str) -> list[str]:
        if SPECIAL not in text and PLAIN(text):
            text = text.lower()
        return text.replace("\n", " ").replace("\t", " ").split(" ")

    def __missing__(self, run: str) -> bytes:
        ids = self.before.get(run)
        if ids is None:
            stem = run.rstrip(".,")
            if stem != run and stem and PLAIN_END(stem):
                ids = self[stem] + self[run[len(stem) :]]
            else:
                ids = self.encode(run)
        if len(run) <= CACHED_CHARS:
            self[run] = ids
        return ids

    def encode(self, run: str) -> bytes:
        """The merges alone for a plain word, which is one pre-token; the whole tokenizer for others."""
        if not LETTERS(run):
            return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        word = run.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [token.id for token in self.merge(word)]).tobytes()


def minimum_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length the number of its window and its offset there."""
    left = Counter(lengths.tolist())
    places: dict[int, list[tuple[int, int]]] = {n: [] for n in left}
    window = 0
    for longest in sorted(left, reverse=True):
        while left[longest]:
            left[longest] -= 1
            chosen = best_filling(left, capacity - longest)
            left[longest] += 1
            chosen[longest] += 1
            times = min(left[n] // used for n, used in chosen.items())
            for _ in range(times):
                offset = 0
                for n, used in chosen.items():
                    for _ in range(used):
                        places[n].append((window, offset))
                        offset += n
                window += 1
            for n, used in chosen.items():
                left[n] -= used * times
    taken = {n: iter(p) for n, p in places.items()}
    found = np.array([next(taken[n]) for n in lengths.tolist()], dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def best_filling(left: Counter, room: int) -> Counter:
    """The multiset within ``left`` whose sum is the largest that fits into ``room``."""
    reached, full, steps = 1, (1 << (room + 1)) - 1, []
    for n in sorted((n for n, many in left.items() if many and n <= room), reverse=True):
        many, copies = min(left[n], room // n), 1
        while many:
            copies = min(copies, many)
            before, reached = reached, (reached | reached << copies * n) & full
            if reached != before:
                steps.append((n, copies, before))
            many -= copies
            copies *= 2
        if reached >> room:
            break
    total, chosen = reached.bit_length() - 1, Counter()
    for n, copies, before in reversed(steps):
        if not before >> total & 1:
            chosen[n] += copies
            total -= copies * n
    return chosen


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    tokenizer_path: str | None = None,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: where it starts there and in which window it lies.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and the token
    ``ids`` if asked for. Documents are their token ids and ``end_id``; null and empty texts
    are ``end_id`` alone. Equal rows and rows that share an id are documents of their own.
    Other columns are ignored. An empty table gives no rows. ``tokenizer_path`` is a file that
    all executors can read, by default the public word tokenizer. Windows are numbered, with
    gaps.
    """

    def pieces(batches):
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        tokens, end = TokenBytes(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in in_parts(batches, 1):
            yield cut(batch.column(0), tokens.of(batch.column(1).to_pylist()), end)

    def cut(ids, documents, end):
        rows, starts, lengths, sums, totals, content = [], [], [], [], [], []
        for row, data in enumerate(documents):
            data += end
            total = len(data) // 4
            for start in range(0, total, window):
                part = data[4 * start : 4 * (start + window)]
                rows.append(row)
                starts.append(start)
                lengths.append(len(part) // 4)
                sums.append(zlib.crc32(part))
                totals.append(total)
                if with_ids:
                    content.append(part)
        arrays = [ids.take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
        if with_ids:
            arrays.append(list_array(np.frombuffer(b"".join(content), dtype="<i4"), lengths))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    source = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string"))
    longs = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    ids = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType([source.schema["doc_id"], *longs, *ids])
    names = schema.names
    # Written once, so that the numbers given to rows below stay whatever is run again.
    cut_up = checkpointed(source.mapInArrow(pieces, schema)).withColumn("row", F.monotonically_increasing_id())
    full = cut_up.where(F.col("length") == window)
    full = full.select(*names, (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut_up.where(F.col("length") < window)
    groups = partitions_for(rest.count(), GROUP)

    def fill(group: pa.Table) -> pa.Table:
        at, offset = minimum_slack(group["length"].to_numpy(), window)
        number = (group["share"].to_numpy() << 32 | at) * 2
        return group.select(names).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    packed = T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    rest = rest.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return full.union(rest.groupBy("share").applyInArrow(fill, packed))
