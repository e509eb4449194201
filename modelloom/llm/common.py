"""What several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from modelloom.functions import col
from modelloom.session import ensure_checkpoint_dir

#: Odd 64-bit constants: a multiplier for rolling hashes and two for the final mixing.
ROLL = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes of text that a worker takes up at a time.
PART_BYTES = 1_000_000


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark hand long texts to Python in smaller batches than its default, unless the session has its own number."""
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, rows)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5 == 0


def unclashing(df: DataFrame, added: Iterable[str]) -> list[str]:
    """Columns of ``df`` whose names differ from the ``added`` ones, whatever the case."""
    taken = {name.lower() for name in added}
    return [name for name in df.columns if name.lower() not in taken]


def with_text_columns(
    df: DataFrame,
    text_col: str,
    compute: Callable[[], Callable[[list[str | None]], Sequence]],
    schema: str,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` (all columns by default) and columns that are computed from the texts.

    ``compute`` runs once per task and returns a function from a list of texts to one
    array per field of ``schema``. A kept column with the name of a new one gives way.
    Rows stay where they are: nothing is shuffled.
    """
    added = T._parse_datatype_string(schema)
    kept = unclashing(df, added.names) if keep is None else [c for c in keep if c in unclashing(df, added.names)]
    source = df.select(*[col(c) for c in kept], col(text_col).cast("string").alias("__text"))
    out = T.StructType([*source.schema.fields[:-1], *added.fields])
    arrow, n = to_arrow_schema(out), len(kept)
    new_types = [arrow.field(n + i).type for i in range(len(added))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = compute()
        for batch in in_parts(batches, n):
            values = function(batch.column(n).to_pylist())
            arrays = [as_arrow(v, t) for v, t in zip(values, new_types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=out.names)

    return source.mapInArrow(run, out)


def in_parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``PART_BYTES`` in column ``text``, so that memory stays bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, a = np.cumsum(sizes.astype(np.int64) + 100), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART_BYTES)))
            yield batch.slice(a, b - a)
            a = b


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def list_array(values: np.ndarray, lengths: Sequence[int]) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return text.encode().split() if text else []


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that any of their bits can be used."""
    values = (values ^ (values >> np.uint64(30))) * MIX[0]
    values = (values ^ (values >> np.uint64(27))) * MIX[1]
    return values ^ (values >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words, of the whole sequence if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    rolled = hashes[: n - size + 1].copy()
    for i in range(1, size):
        rolled = rolled * ROLL + hashes[i : n - size + 1 + i]
    return mixed(rolled)


def key_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from batches that are sorted by the keys."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edges = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            edges[1:] |= c[1:] != c[:-1]
        edges[0] = last is None or any(c[0] != x for c, x in zip(columns, last, strict=True))
        starts = [*np.flatnonzero(edges).tolist(), batch.num_rows]
        if starts[0] > 0:
            rest.append(batch.slice(0, starts[0]))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if rest:
                yield pa.Table.from_batches(rest)
            rest = [batch.slice(a, b - a)]
        last = [c[-1] for c in columns]
    if rest:
        yield pa.Table.from_batches(rest)


def partitions_for(rows: int, rows_each: int) -> int:
    return max(1, -(-rows // rows_each))
