"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Each shingle of words is hashed once; the highest bits choose its bin, every bin keeps its
smallest hash. An empty bin takes the value of the first filled bin along a random order of
all bins that is its own and the same for all documents. Of each value a few low bits are
stored. Two fingerprints agree in a bin by chance once in ``2 ** bits``, which the estimate
of the likeness takes off.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.functions import col
from modelloom.llm.common import ROLL, in_parts, mixed, shingles, with_text_columns, word_hashes, words_of


@dataclass(frozen=True)
class Fingerprints:
    """Fingerprints of ``bins`` values of ``bits`` (1, 2, 4 or 8) from shingles of ``words`` words."""

    words: int = 5
    bins: int = 512
    bits: int = 4
    seed: int = 1

    def __post_init__(self):
        if self.bins & (self.bins - 1) or self.bins < 8 or self.bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two from 8 on, bits 1, 2, 4 or 8")

    @cached_property
    def turns(self) -> np.ndarray:
        """``turns[i, j]``: when the empty bin ``i`` asks bin ``j``."""
        order = np.tile(np.arange(self.bins, dtype=np.int16), (self.bins, 1))
        return np.random.default_rng(self.seed).permuted(order, axis=1)

    def values(self, text: str | None) -> np.ndarray | None:
        """The low bits kept of each bin; None for a text without words."""
        found = np.sort(shingles(word_hashes(words_of(text)), self.words))
        if not len(found):
            return None
        # The order by hash is the order by bin, so the first of each bin is its smallest.
        bin_ = (found >> np.uint64(65 - self.bins.bit_length())).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bin_[1:] != bin_[:-1]])
        filled, kept = bin_[first], found[first]
        out = np.zeros(self.bins, dtype=np.uint64)
        out[filled] = kept
        empty = np.ones(self.bins, dtype=bool)
        empty[filled] = False
        (empty,) = np.nonzero(empty)
        if len(empty):
            out[empty] = kept[self.turns[np.ix_(empty, filled)].argmin(axis=1)]
        # Mixed with the bin's number, so that bins which share a value agree by chance independently.
        return (mixed(out + np.arange(self.bins, dtype=np.uint64) * ROLL) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def packed(self, values: np.ndarray | None) -> str:
        """Hexadecimal digits of the bits, bin after bin; an empty string for no words."""
        if values is None:
            return ""
        bits = np.unpackbits(values[:, None], axis=1, count=self.bits, bitorder="little")
        return np.packbits(bits, bitorder="little").tobytes().hex()

    def unpacked(self, digits: str) -> np.ndarray | None:
        if not digits:
            return None
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(digits), dtype=np.uint8), bitorder="little")
        return np.packbits(bits.reshape(self.bins, self.bits), axis=1, bitorder="little")[:, 0]

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """Estimated Jaccard likeness of the shingles; without words, 1 for both and 0 for one."""
        if a is None or b is None:
            return float(a is None and b is None)
        chance = 0.5**self.bits
        return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def fingerprint_documents(docs: DataFrame, text_col: str = "text", how: Fingerprints = Fingerprints(), keep: list[str] | None = None) -> DataFrame:
    """``fingerprint`` of every row's whole text; empty for null texts and texts without words.

    Equal texts have equal fingerprints. A kept column of that name gives way.
    """
    return with_text_columns(docs, text_col, lambda: lambda texts: [[how.packed(how.values(t)) for t in texts]], "fingerprint string", keep)


def edited(text: str, following: str) -> str:
    """``text`` whose last half is replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Fingerprints = Fingerprints()) -> DataFrame:
    """Fingerprints of every text and of its edited form, compared with each other and with the next text's.

    The next row is that of the next number in ``id_col``, after the last the first; null ids
    come first, rows that share an id are ordered by their text. Null texts are empty. Every
    row gives a row ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``; a single row is its own next. Other columns are ignored.

    Ranges of ids are dealt out, each with the first row after it, so a text is shuffled
    once. Ids are meant to be unique: rows of one id stay in one range.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    # Four ranges for a shuffle partition even them out; only their bounds reach the driver.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / (4 * parts) for i in range(1, 4 * parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", cuts, 20 * len(cuts))).first()[0] or []))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right"))

    ids = F.col("doc_id")
    rows = rows.withColumn("range", F.when(ids.isNull(), 0).otherwise(place(F.coalesce(ids, F.lit(0)))))
    firsts = rows.groupBy("range").agg(F.min("doc_id").alias("low"), F.count_if(ids.isNull()).alias("nulls")).orderBy("range").collect()
    before = {r["range"]: firsts[i - 1]["range"] for i, r in enumerate(firsts)}
    table = [(r["range"], None if r.nulls else r.low, before[r["range"]]) for r in firsts]
    kind = rows.schema["doc_id"].dataType.simpleString()
    # As many rows as there are ranges.
    table = F.broadcast(spark.createDataFrame(table, f"head_range int, low {kind}, before int"))
    heads = rows.join(table, (F.col("range") == F.col("head_range")) & F.col("doc_id").eqNullSafe(F.col("low")))
    heads = heads.groupBy("before").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    heads = heads.select("head.doc_id", "head.text", F.col("before").alias("range"), F.lit(1).alias("added"))
    dealt = rows.withColumn("added", F.lit(0)).unionByName(heads)
    dealt = dealt.select("doc_id", "text", "range", "added").repartition(parts, "range").sortWithinPartitions("range", "added", "doc_id", "text")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(batches):
        earlier = None
        for batch in in_parts(batches, 1):
            out = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for key, text, place, added in zip(*columns, strict=True):
                values = how.values(text)
                if earlier is not None and earlier[2] == place:
                    out.append(compared(how, *earlier, text, values))
                earlier = None if added else (key, text, place, values)
            if out:
                arrays = [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types(batch.schema.field(0).type), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split(" ")[0] for f in schema.split(", ")])

    def types(key):
        return [key, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

    return dealt.mapInArrow(compare, schema)


def compared(how: Fingerprints, key, text: str, place: int, values, following: str, next_values) -> tuple:
    changed = edited(text, following)
    changed_values = how.values(changed)
    return (
        key,
        len(text),
        hashlib.sha256(changed.encode()).hexdigest(),
        how.packed(values),
        how.packed(changed_values),
        how.likeness(values, changed_values),
        how.likeness(values, next_values),
    )
