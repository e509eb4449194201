"""Train/test splits that do not depend on how rows are partitioned."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelloom.functions import col, content_hash, epoch_micros, field, is_time, like_column
from modelloom.session import ensure_checkpoint_dir

HASH_DIGITS = 32
STEP_DIGITS = 4
COLLECT_AT_MOST = 50_000
COPIES_PER_CHUNK = 65_536

_HASH, _CONTENT, _CHUNK = "__hash", "__content", "__chunk"
_COPIES, _COPY, _SAMPLED = "__copies", "__copy", "__sampled"


class Split(NamedTuple):
    train: DataFrame
    test: DataFrame


class Periods(NamedTuple):
    """Training is [start, cut], testing is what follows cut up to end."""

    start: str | None
    cut: str
    end: str | None


def parse_share(value: str | float) -> float:
    """'70%' or 0.7 -> 0.7."""
    if isinstance(value, str):
        text = value.strip()
        share = float(text[:-1]) / 100 if text.endswith("%") else float(text)
    else:
        share = float(value)
    if not 0 < share < 1:
        raise ValueError(f"the training share must lie between 0 and 1, not {value!r}")
    return share


def split_random(
    df: DataFrame,
    share: str | float = 0.7,
    seed: int = 123,
    key_cols: Sequence[str] | None = None,
    exact: bool = True,
) -> Split:
    """``round(n * share)`` rows drawn without replacement, and the rest.

    With ``key_cols`` (unique per row) both sides are plain filters on a hash of
    the key: no shuffle, no join. Without them equal rows are counted and numbered,
    and the test side holds the rows whose content was not drawn at all; that costs
    one shuffle and one checkpoint of the table, so pass a key wherever there is
    one. ``exact=False`` draws about ``share`` of the rows without counting them.
    """
    share = parse_share(share)
    if key_cols:
        for name in key_cols:
            field(df, name)
        rank = content_hash(seed, key_cols)
        drawn = _rule(df.select(rank.alias(_HASH)), share, exact)(rank)
        return Split(df.filter(drawn), df.filter(~drawn))
    return _split_equal_rows(df, share, seed, exact)


def sample_rows(df: DataFrame, rows: int, seed: int = 123, key_cols: Sequence[str] | None = None) -> DataFrame:
    """Exactly ``rows`` rows drawn without replacement, those of least hash; all if there are no more.

    With ``key_cols`` (unique per row) this is a filter on a hash of the key; without, equal
    rows are counted and numbered, for which the table is shuffled and checkpointed once.
    """
    if rows < 0:
        raise ValueError(f"the number of rows must not be negative, not {rows}")
    if key_cols:
        rank = content_hash(seed, key_cols)
        last = _boundary(df.select(rank.alias(_HASH)), rows=rows)
        return df.filter(rank <= F.lit(last))
    names = [col(c) for c in df.columns]
    counted = _counted(df, seed)
    numbered = _number_few(counted).unionByName(_number_many(counted))
    rank = F.md5(F.concat_ws("|", _CONTENT, F.col(_COPY).cast("string")))
    last = _boundary(numbered.select(rank.alias(_HASH)), rows=rows)
    return numbered.filter(rank <= F.lit(last)).select(*names)


def _counted(df: DataFrame, seed: int) -> DataFrame:
    """One row per content with its number of copies and a hash, kept as files, as several passes read it."""
    names = [col(c) for c in df.columns]
    ensure_checkpoint_dir(df.sparkSession)
    return (
        df.groupBy(*names)
        .agg(F.count(F.lit(1)).alias(_COPIES))
        .withColumn(_CONTENT, F.md5(F.concat_ws("|", F.lit(str(seed)), F.to_json(F.struct(*names)))))
        .checkpoint()
    )


def _split_equal_rows(df: DataFrame, share: float, seed: int, exact: bool) -> Split:
    names = [col(c) for c in df.columns]
    counted = _counted(df, seed)

    def rank(copy: Column) -> Column:
        return F.md5(F.concat_ws("|", _CONTENT, copy.cast("string")))

    few, many = _number_few(counted), _number_many(counted)
    numbered = few.unionByName(many)
    rule = _rule(numbered.select(rank(F.col(_COPY)).alias(_HASH)), share, exact)
    train = numbered.filter(rule(rank(F.col(_COPY)))).select(*names)
    # A content with few copies is judged in its own row; one with many copies by
    # its spread-out chunks, folded per task before they meet.
    copies = F.sequence(F.lit(0).cast("long"), F.col(_COPIES) - 1)
    small = counted.filter((F.col(_COPIES) <= COPIES_PER_CHUNK) & ~F.exists(copies, lambda c: rule(rank(c))))
    large = (
        many.groupBy(*names, _CONTENT)
        .agg(F.count(F.lit(1)).alias(_COPIES), F.max(rule(rank(F.col(_COPY)))).alias(_SAMPLED))
        .filter(~F.col(_SAMPLED))
        .drop(_SAMPLED)
    )
    test = _number_few(small).unionByName(_number_many(large)).select(*names)
    return Split(train, test)


def _rule(hashes: DataFrame, share: float, exact: bool) -> Callable[[Column], Column]:
    """The test a rank hash must pass for its row to be drawn."""
    if not exact:
        return lambda rank: F.substring(rank, 1, 8) < F.lit(f"{int(share * 2**32):08x}")
    last = _boundary(hashes, share)
    return lambda rank: rank <= F.lit(last)


def _boundary(hashes: DataFrame, share: float | None = None, rows: int | None = None) -> str:
    """The hash of the last drawn row, of a share of the rows or of a number of them.

    Each pass counts rows per four more hex digits (at most 65,536 groups) and
    descends into the group holding the boundary, until that group is small
    enough to sort. Three passes cover 10^14 rows; no pass sorts the table.
    """
    prefix, wanted = "", None
    for width in range(STEP_DIGITS, HASH_DIGITS + 1, STEP_DIGITS):
        counts = sorted(
            hashes.filter(F.col(_HASH).startswith(prefix))
            .groupBy(F.substring(_HASH, 1, width).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        if wanted is None:
            total = sum(r["n"] for r in counts)
            wanted = round(total * share) if rows is None else min(rows, total)
            if wanted == 0:
                return ""
            if wanted == total:
                return "f" * HASH_DIGITS
        for row in counts:
            if row["n"] >= wanted:
                break
            wanted -= row["n"]
        prefix = row["prefix"]
        if row["n"] == wanted:
            return prefix + "f" * (HASH_DIGITS - width)
        if row["n"] <= COLLECT_AT_MOST:
            found = sorted(r[0] for r in hashes.filter(F.col(_HASH).startswith(prefix)).collect())
            if found[wanted] == found[wanted - 1]:
                break
            return found[wanted - 1]
    raise ValueError("key_cols do not tell all rows apart, so no exact share can be drawn; leave them out")


def _number_few(counted: DataFrame) -> DataFrame:
    """Rows with up to a chunk of copies, each as often as ``__copies`` says, numbered from 0."""
    n = F.col(_COPIES)
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    return counted.filter((n > 0) & (n <= COPIES_PER_CHUNK)).withColumn(_COPY, numbers).drop(_COPIES)


def _number_many(counted: DataFrame) -> DataFrame:
    """The same for rows with more copies.

    They are cut into chunks that are spread over the cluster before they are
    repeated, so no task writes out one hot row alone.
    """
    n = F.col(_COPIES)
    starts = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(COPIES_PER_CHUNK).cast("long"))
    last = F.least(n, F.col(_CHUNK) + F.lit(COPIES_PER_CHUNK)) - 1
    return (
        counted.filter(n > COPIES_PER_CHUNK)
        .withColumn(_CHUNK, F.explode(starts))
        .repartition(_CHUNK, *[col(c) for c in counted.columns if c != _COPIES])
        .withColumn(_COPY, F.explode(F.sequence(F.col(_CHUNK), last)))
        .drop(_CHUNK, _COPIES)
    )


def complement(df: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of ``df`` whose content does not occur in ``sample``.

    NULL equals NULL; repeated rows stay repeated. Both sides meet in one grouped
    pass: equal rows fold together before the shuffle, so a row that fills a third
    of the table is one record per task, and nothing is joined or broadcast.
    """
    names = df.columns
    if list(sample.columns) != list(names):
        sample = sample.select(*[col(c) for c in names])
    tagged = df.select("*", F.lit(1).cast("long").alias(_COPIES), F.lit(0).alias(_SAMPLED)).union(
        sample.select("*", F.lit(0).cast("long").alias(_COPIES), F.lit(1).alias(_SAMPLED))
    )
    counted = (
        tagged.groupBy(*[col(c) for c in names])
        .agg(F.sum(_COPIES).alias(_COPIES), F.max(_SAMPLED).alias(_SAMPLED))
        .filter(F.col(_SAMPLED) == 0)
        .drop(_SAMPLED)
    )
    return _number_few(counted).unionByName(_number_many(counted)).drop(_COPY)


def time_bounds(df: DataFrame, time_col: str, by_day: bool = False) -> DataFrame:
    """One row: earliest, mean and latest value. ``by_day`` drops the time of day first."""
    dtype = field(df, time_col).dataType
    if not is_time(dtype):
        raise TypeError(f"column {time_col!r} is {dtype.simpleString()}, not a date or timestamp")
    c = col(time_col)
    if by_day or isinstance(dtype, T.DateType):
        day = c.cast("date")
        mean = F.date_from_unix_date(F.floor(F.avg(F.unix_date(day))).cast("int"))
        return df.agg(F.min(day).alias("start"), mean.alias("mean"), F.max(day).alias("end"))
    mean_micros = F.avg(epoch_micros(df, time_col)).cast("long")
    if isinstance(dtype, T.TimestampNTZType):
        day = F.date_from_unix_date(F.floor(mean_micros / F.lit(86_400_000_000)).cast("int"))
        in_day = F.pmod(mean_micros, F.lit(86_400_000_000))
        mean = day.cast("timestamp_ntz") + F.make_dt_interval(secs=in_day / F.lit(1e6))
    else:
        mean = F.timestamp_micros(mean_micros)
    return df.agg(F.min(c).alias("start"), mean.alias("mean"), F.max(c).alias("end"))


def default_periods(df: DataFrame, time_col: str) -> Periods:
    """Train from the earliest to the mean value, test from there to the latest."""
    row = time_bounds(df, time_col).select(*[F.col(c).cast("string") for c in ("start", "mean", "end")]).first()
    if row["mean"] is None:
        raise ValueError(f"time column {time_col!r} holds no value")
    return Periods(row["start"], row["mean"], row["end"])


def split_time(
    df: DataFrame,
    time_col: str,
    cut=None,
    start=None,
    end=None,
    end_inclusive: bool = True,
) -> Split:
    """Rows in [start, cut] and rows in (cut, end], as two pushed-down filters.

    Without ``cut`` the default periods apply. ``start`` or ``end`` left out is
    open. ``end_inclusive=False`` leaves rows at ``end`` out of the test side.
    """
    dtype = field(df, time_col).dataType
    if not is_time(dtype):
        raise TypeError(f"column {time_col!r} is {dtype.simpleString()}, not a date or timestamp")
    if cut is None:
        start, cut, end = default_periods(df, time_col)
    # Compared as values of the column's type, whatever text they come as.
    bounds = [F.lit(v if v is None else str(v)).cast(dtype) for v in (start, cut, end)]
    ordered = [a <= b for a, b in zip(bounds, bounds[1:])] + [bounds[0] <= bounds[2], (bounds[1] != bounds[2]) | (bounds[0] == bounds[2])]
    if not df.sparkSession.range(1).select(*[F.coalesce(o, F.lit(True)).alias(f"o{i}") for i, o in enumerate(ordered)]).filter("o0 AND o1 AND o2 AND o3").count():
        raise ValueError(f"periods must run forward: start={start}, cut={cut}, end={end}")
    t = col(time_col)
    in_train = t <= like_column(df, time_col, cut)
    in_test = t > like_column(df, time_col, cut)
    if start is not None:
        in_train = (t >= like_column(df, time_col, start)) & in_train
    if end is not None:
        bound = like_column(df, time_col, end)
        in_test = in_test & ((t <= bound) if end_inclusive else (t < bound))
    return Split(df.filter(in_train), df.filter(in_test))


def between(df: DataFrame, time_col: str, first, last) -> DataFrame:
    """Rows with ``first <= time <= last``."""
    t = col(time_col)
    return df.filter((t >= like_column(df, time_col, first)) & (t <= like_column(df, time_col, last)))


def split_counts(split: Split) -> DataFrame:
    """Rows per side."""
    sides = [
        side.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("side"), "n_rows")
        for name, side in zip(("train", "test"), split)
    ]
    return sides[0].unionByName(sides[1])
