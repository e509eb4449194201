"""The tables behind the explorative charts.

Small aggregates (ranges, counts, quantile brackets) come to the driver and go
back into the next pass as constants; rows never do.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.functions import col
from modelloom.functions.vectors import sum_vectors
from modelloom.operators.reshape import with_counter
from modelloom.operators.schema import numeric_columns, require_numeric
from modelloom.operators.split import sample_rows

KDE_NODES = 4096
DISTINCT_AT_MOST = 100_000
BRACKET_ACCURACY = 10_000
BLOCK_ROWS = 65_536


def _valid(df: DataFrame, name: str) -> DataFrame:
    """The column as a double named x, without NULL, NaN and infinities."""
    require_numeric(df, name)
    return df.select(_finite(name).alias("x")).filter("x IS NOT NULL")


def _finite(name: str):
    """The column as a double; NaN and infinities, which have no place in a range, become NULL."""
    x = col(name).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def histogram(df: DataFrame, name: str, bins: int = 30, centered: bool = False) -> DataFrame:
    """Equal-width bins with count and density; empty bins are present."""
    return histograms(df, [name], bins, centered).drop("variable")


def histograms(df: DataFrame, names: Sequence[str] | None = None, bins: int = 30, centered: bool = False) -> DataFrame:
    """Histograms of several columns from two passes over the table.

    ``centered`` puts the first bin's middle on the minimum and the last bin's
    middle on the maximum, as chart libraries do; otherwise bins tile the range.
    NULL, NaN and infinite values are left out.
    """
    if bins < 1 or (centered and bins < 2):
        raise ValueError("bins must be at least 1, or 2 when centered")
    spark = df.sparkSession
    names = numeric_columns(df) if names is None else list(names)
    for name in names:
        require_numeric(df, name)
    number = {n: _finite(n) for n in names}
    stats = df.agg(
        *[f(number[n]).alias(f"{tag}{i}") for i, n in enumerate(names) for tag, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    ).first()
    layout, parts = [], []
    for i, name in enumerate(names):
        lo, hi, n = stats[f"lo{i}"], stats[f"hi{i}"], stats[f"n{i}"]
        if n == 0:
            continue
        if lo == hi:
            layout.append((name, 0, lo, hi, n, None))
            parts.append(F.struct(F.lit(name).alias("variable"), F.when(number[name].isNotNull(), 0).alias("bin")))
            continue
        width = (hi - lo) / (bins - 1 if centered else bins)
        first = lo - width / 2 if centered else lo
        slot = F.least(F.floor((number[name] - F.lit(first)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        parts.append(F.struct(F.lit(name).alias("variable"), F.when(number[name].isNotNull(), slot).alias("bin")))
        layout += [(name, b, first + b * width, first + (b + 1) * width, n, width) for b in range(bins)]
    frame = spark.createDataFrame(
        layout or [("", 0, 0.0, 0.0, 0, 0.0)],
        "variable string, bin int, lo double, hi double, n long, width double",
    )
    if not layout:
        return frame.select("variable", "bin", "lo", "hi", F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("density")).limit(0)
    counts = (
        df.select(F.inline(F.array(*parts)))
        .filter("bin IS NOT NULL")
        .groupBy("variable", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    filled = F.coalesce(F.col("count"), F.lit(0).cast("long"))
    return frame.join(counts, ["variable", "bin"], "left").select(
        "variable",
        "bin",
        "lo",
        "hi",
        filled.alias("count"),
        F.when(F.col("width").isNotNull(), filled / (F.col("n") * F.col("width"))).alias("density"),
    )


def exact_quantiles(df: DataFrame, name: str, probs: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation between order statistics, exact at any size.

    Each wanted rank is narrowed to a bracket by approximate percentiles until the
    brackets hold few distinct values, which are then counted. All ranks share the
    passes; no task sorts the column or holds it whole.
    """
    values = _valid(df, name)
    row = values.agg(F.count("x").alias("n"), F.approx_count_distinct("x").alias("distinct")).first()
    total = row["n"]
    if total == 0:
        return [None] * len(probs)
    spots = [((total - 1) * p) for p in probs]
    wanted = sorted({r for h in spots for r in (math.floor(h), math.ceil(h))})
    if row["distinct"] <= DISTINCT_AT_MOST:
        found = _pick(_value_counts(values), wanted, 0)
    else:
        found = _narrow(values, wanted, total)
    low = [found[math.floor(h)] for h in spots]
    high = [found[math.ceil(h)] for h in spots]
    return [a + (b - a) * (h - math.floor(h)) for a, b, h in zip(low, high, spots)]


@dataclass
class _Bracket:
    """A value range known to hold the given 0-based ranks of the sorted column."""

    ranks: list[int]
    lo: float
    hi: float
    below: int
    rows: int
    done: bool = False

    def holds(self):
        return F.col("x").between(F.lit(self.lo), F.lit(self.hi))

    def edges(self) -> list[float]:
        slack = 2 * self.rows / BRACKET_ACCURACY + 1
        first = (self.ranks[0] - self.below - slack) / self.rows
        last = (self.ranks[-1] - self.below + 1 + slack) / self.rows
        return [max(0.0, first), min(1.0, last)]

    def middle(self) -> float:
        return min(1.0, (self.ranks[len(self.ranks) // 2] - self.below + 0.5) / self.rows)


def _narrow(values: DataFrame, wanted: list[int], total: int) -> dict[int, float]:
    """The values at the wanted ranks, each bracket narrowed until few distinct values are left in it."""
    brackets: list[_Bracket] = []
    for rank in wanted:
        if brackets and rank - brackets[-1].ranks[-1] <= 1:
            brackets[-1].ranks.append(rank)
        else:
            brackets.append(_Bracket([rank], -math.inf, math.inf, 0, total))
    found: dict[int, float] = {}
    while open_ones := [b for b in brackets if not b.done]:
        # A value that fills a good part of a bracket is where the sketch gets stuck. The
        # middle one is tried as an answer, or else as a new edge, in the same pass.
        cuts = values.agg(
            *[
                F.percentile_approx(F.when(b.holds(), F.col("x")), [*b.edges(), b.middle()], BRACKET_ACCURACY).alias(f"q{i}")
                for i, b in enumerate(open_ones)
            ]
        ).first()
        tries = []
        for i, b in enumerate(open_ones):
            first, last = b.edges()
            lo, hi, mid = cuts[i]
            tries.append((max(b.lo, lo) if first > 0 else b.lo, min(b.hi, hi) if last < 1 else b.hi, mid))
        sizes = values.agg(
            *[
                f
                for i, (b, (lo, hi, mid)) in enumerate(zip(open_ones, tries))
                for f in (
                    F.count_if(F.col("x") < F.lit(lo)).alias(f"below{i}"),
                    F.count_if(F.col("x").between(F.lit(lo), F.lit(hi))).alias(f"rows{i}"),
                    F.approx_count_distinct(F.when(F.col("x").between(F.lit(lo), F.lit(hi)), F.col("x"))).alias(f"distinct{i}"),
                    F.count_if(F.col("x") < F.lit(mid)).alias(f"under{i}"),
                    F.count_if(F.col("x") <= F.lit(mid)).alias(f"upto{i}"),
                    F.max(F.when((F.col("x") < F.lit(mid)) & b.holds(), F.col("x"))).alias(f"before{i}"),
                    F.min(F.when((F.col("x") > F.lit(mid)) & b.holds(), F.col("x"))).alias(f"after{i}"),
                )
            ]
        ).first()
        for i, (b, (lo, hi, mid)) in enumerate(zip(open_ones, tries)):
            below, rows = sizes[f"below{i}"], sizes[f"rows{i}"]
            # A sketch that missed the ranks leaves the bracket as wide as it was.
            if below <= b.ranks[0] and b.ranks[-1] < below + rows:
                b.lo, b.hi, b.below, b.rows = lo, hi, below, rows
                if sizes[f"distinct{i}"] <= DISTINCT_AT_MOST:
                    b.done = True
                    continue
            under, upto = sizes[f"under{i}"], sizes[f"upto{i}"]
            found |= {r: mid for r in b.ranks if under <= r < upto}
            left = [r for r in b.ranks if not under <= r < upto]
            if not left:
                b.ranks, b.done = [], True
            elif left[-1] < under and mid > b.lo:
                b.ranks, b.hi, b.rows = left, sizes[f"before{i}"], under - b.below
            elif left[0] >= upto and mid < b.hi:
                b.ranks, b.lo, b.rows, b.below = left, sizes[f"after{i}"], b.below + b.rows - upto, upto
            else:
                # Ranks on both sides of the middle value: one bracket each.
                upper = _Bracket([r for r in left if r >= upto], sizes[f"after{i}"], b.hi, upto, b.below + b.rows - upto)
                b.ranks, b.hi, b.rows = [r for r in left if r < under], sizes[f"before{i}"], under - b.below
                brackets.append(upper)
    brackets = [b for b in brackets if b.ranks]
    if not brackets:
        return found
    inside = reduce(lambda a, b: a | b, [b.holds() for b in brackets])
    counts = _value_counts(values.filter(inside))
    for b in brackets:
        found |= _pick(counts[(counts["x"] >= b.lo) & (counts["x"] <= b.hi)], b.ranks, b.below)
    return found


def _value_counts(values: DataFrame):
    return values.groupBy("x").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("x")


def _pick(counts, wanted: list[int], below: int) -> dict[int, float]:
    ends = below + counts["n"].cumsum().to_numpy()
    xs = counts["x"].to_numpy()
    return {r: float(xs[np.searchsorted(ends, r, side="right")]) for r in wanted}


def box_stats(df: DataFrame, name: str, approx: bool = False) -> DataFrame:
    """One row of box-plot statistics with 1.5 * IQR fences."""
    values = _valid(df, name)
    if approx:
        quartiles = values.agg(F.percentile_approx("x", [0.25, 0.5, 0.75], BRACKET_ACCURACY)).first()[0] or [None] * 3
    else:
        quartiles = exact_quantiles(df, name, [0.25, 0.5, 0.75])
    q1, median, q3 = quartiles
    if q1 is None:
        lo_fence = hi_fence = iqr = None
    else:
        iqr = q3 - q1
        lo_fence, hi_fence = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    x = F.col("x")
    inside = (x >= F.lit(lo_fence)) & (x <= F.lit(hi_fence))
    fixed = {"q1": q1, "median": median, "q3": q3, "iqr": iqr, "lo_fence": lo_fence, "hi_fence": hi_fence}
    return values.agg(
        F.count("x").alias("n"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.min(F.when(inside, x)).alias("lo_whisker"),
        F.max(F.when(inside, x)).alias("hi_whisker"),
        F.count_if(~inside).alias("n_outliers"),
    ).select(
        "n",
        "min",
        *[F.lit(fixed[k]).cast("double").alias(k) for k in ("q1", "median", "q3")],
        "max",
        *[F.lit(fixed[k]).cast("double").alias(k) for k in ("iqr", "lo_fence", "hi_fence")],
        "lo_whisker",
        "hi_whisker",
        "n_outliers",
    )


def outliers(df: DataFrame, name: str) -> DataFrame:
    """All rows whose value lies outside the fences."""
    row = box_stats(df, name).first()
    return df.filter((col(name) < F.lit(row["lo_fence"])) | (col(name) > F.lit(row["hi_fence"])))


def kde(df: DataFrame, name: str, points: int = 512, bw: float | None = None) -> DataFrame:
    """Gaussian density at evenly spaced points over the column's range.

    Rows are first spread linearly over 4,097 nodes in one grouped pass; only
    those nodes meet the grid, so the second step costs the same at any size.
    The default bandwidth is 0.9 * min(sd, IQR / 1.34) * n^(-1/5).
    """
    spark = df.sparkSession
    values = _valid(df, name)
    row = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"), F.stddev_samp("x").alias("sd")).first()
    lo, hi, n = row["lo"], row["hi"], row["n"]
    if n < 2:
        raise ValueError("a density needs at least two values")
    if bw is None:
        q1, q3 = exact_quantiles(df, name, [0.25, 0.75])
        spread = min(row["sd"], (q3 - q1) / 1.34) or row["sd"] or abs(lo) or 1.0
        bw = 0.9 * spread * n ** (-0.2)
    if bw <= 0:
        raise ValueError("the bandwidth must be positive")
    step = (hi - lo) / KDE_NODES or 1.0
    place = (F.col("x") - F.lit(lo)) / F.lit(step)
    node = F.least(F.floor(place), F.lit(KDE_NODES - 1)).cast("int")
    nodes = values.groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("c"), F.sum(place - node).alias("f"))
    gap = (hi - lo) / (points - 1) if points > 1 else 0.0
    x = F.lit(lo) + F.col("point") * F.lit(gap)

    def bump(at):
        return F.exp(F.lit(-0.5) * F.pow((x - (F.lit(lo) + at * F.lit(step))) / F.lit(bw), 2))

    mass = (F.col("c") - F.col("f")) * bump(F.col("node")) + F.col("f") * bump(F.col("node") + 1)
    return (
        nodes.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy("point")
        .agg(F.sum(mass).alias("mass"))
        .select("point", x.alias("x"), (F.col("mass") / F.lit(n * bw * math.sqrt(2 * math.pi))).alias("density"))
    )


def autocorrelation(df: DataFrame, name: str, order_by: Sequence[str], max_lag: int = 100, nulls: str = "error") -> DataFrame:
    """(Lag, ACF) for lags 0 .. min(max_lag, n - 1) of the series in the given order.

    Rows are numbered by a range sort, cut into blocks of fixed length that also
    hold the first ``max_lag`` rows of the next block, and each block adds up its
    own lagged products; one small grouped sum joins them.
    """
    if nulls not in ("error", "skip"):
        raise ValueError("nulls must be 'error' or 'skip'")
    require_numeric(df, name)
    series = df.select(*[col(c) for c in dict.fromkeys(order_by)], col(name).cast("double").alias("__x"))
    usable = F.col("__x").isNotNull() & ~F.isnan("__x")
    row = series.agg(F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("ok"), F.avg(F.when(usable, F.col("__x"))).alias("mean")).first()
    if row["ok"] < row["n"]:
        if nulls == "error":
            raise ValueError(f"column {name!r} has missing values; pass nulls='skip' to leave those rows out")
        series = series.filter(usable)
    n = row["ok"]
    if n == 0:
        raise ValueError(f"column {name!r} holds no value")
    lags = min(max_lag, n - 1)
    size = max(BLOCK_ROWS, lags)
    at = F.col("__i") - 1
    numbered = with_counter(series, order_by, "__i").select(at.alias("i"), (F.col("__x") - F.lit(row["mean"])).alias("x"))
    home = F.floor(F.col("i") / F.lit(size)).cast("long")
    reach = F.when((F.col("i") % F.lit(size) < F.lit(lags)) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    blocks = numbered.select(F.explode(reach).alias("block"), "i", "x")

    def products(key, table):
        i = table.column("i").to_numpy()
        order = np.argsort(i)
        x = table.column("x").to_numpy()[order]
        own = int(np.searchsorted(i[order], (key[0].as_py() + 1) * size))
        sums = [float(x[: min(own, len(x) - k)] @ x[k : k + min(own, len(x) - k)]) if k < len(x) else 0.0 for k in range(lags + 1)]
        return pa.table({"Lag": pa.array(range(lags + 1), pa.int32()), "s": pa.array(sums, pa.float64())})

    sums = blocks.groupBy("block").applyInArrow(products, "Lag int, s double").groupBy("Lag").agg(F.sum("s").alias("s"))
    found = {r["Lag"]: r["s"] for r in sums.collect()}
    rows = [(k, found[k] / found[0] if found[0] else None) for k in range(lags + 1)]
    return df.sparkSession.createDataFrame(rows, "Lag int, ACF double")


#: Columns of a block, entries of all blocks that a task adds up at a time, entries of a slice of rows.
CORR_BLOCK, CORR_ENTRIES, SLICE_ENTRIES = 256, 1_000_000, 1_000_000


def correlation_matrix(df: DataFrame, names: Sequence[str] | None = None, block: int = CORR_BLOCK, entries: int = CORR_ENTRIES) -> DataFrame:
    """Pearson correlations of all numeric pairs as (var_x, var_y, corr), both orders.

    Each pair uses the rows where both values are present; a constant column gives
    NULL. One pass takes the means; then columns are dealt to blocks of ``block``, and every task
    adds up centred products for pairs of blocks. The pairs' sums meet by pair, root of the
    number of tasks by root, and are turned into correlations where they meet: neither a task nor the driver holds a
    matrix of all columns by all. A pass serves as many pairs of blocks as have ``entries``, and reads
    the columns of these only; several thousand columns take several passes.
    """
    names = numeric_columns(df) if names is None else list(names)
    for name in names:
        require_numeric(df, name)
    schema = "var_x string, var_y string, corr double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    table = df.select(*[col(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    centre = _column_means(table, len(names))
    starts = list(range(0, len(names), block))
    pairs = [(i, j) for i in range(len(starts)) for j in range(i, len(starts))]
    each = max(1, entries // block**2)
    strips = [pairs[a : a + each] for a in range(0, len(pairs), each)]
    sums = [_block_products(table, strip, starts, block, centre) for strip in strips]
    merged = reduce(DataFrame.unionByName, sums).groupBy("i", "j").agg(Summarizer.sum(F.col("v")).alias("v"))

    def correlations(batches):
        for batch in batches:
            for i, j, flat in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2), strict=True):
                x, y = names[starts[i] : starts[i] + block], names[starts[j] : starts[j] + block]
                r = _correlations(flat.values.to_numpy().reshape(6, len(x), len(y)))
                values = pa.array(np.clip(r, -1, 1).ravel(), from_pandas=True)
                left, right = np.repeat(x, len(y)).tolist(), np.tile(y, len(x)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), values], names=["var_x", "var_y", "corr"])
                if i != j:
                    yield pa.RecordBatch.from_arrays([pa.array(right), pa.array(left), values], names=["var_x", "var_y", "corr"])

    return merged.select("i", "j", vector_to_array("v").alias("v")).mapInArrow(correlations, schema)


def _row_slices(batches, width: int):
    """Float matrices of the batches' columns, of a bounded number of entries each."""
    size = max(1, SLICE_ENTRIES // width)
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)


def _column_means(table: DataFrame, width: int) -> np.ndarray:
    """Means of the present values; 0 for a column without any."""

    def sums(batches):
        total = np.zeros((2, width))
        for x in _row_slices(batches, width):
            seen = ~np.isnan(x)
            total += np.stack([seen.sum(axis=0), np.where(seen, x, 0.0).sum(axis=0)])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": pa.array([total.ravel()], pa.list_(pa.float64()))})

    merged = sum_vectors(table.mapInArrow(sums, "part int, sums array<double>"), "part", "sums")
    n, s = np.zeros((2, width)) if merged is None else merged.reshape(2, width)
    return np.divide(s, n, out=np.zeros(width), where=n > 0)


def _block_products(table: DataFrame, strip: list[tuple[int, int]], starts: list[int], block: int, centre: np.ndarray) -> DataFrame:
    """``i, j, v``: per pair of blocks counts, sums, squares and products over the rows of up to root-many tasks."""
    width = len(table.columns)
    used = sorted({b for pair in strip for b in pair})
    columns = [c for b in used for c in range(starts[b], min(starts[b] + block, width))]
    first = {b: sum(min(block, width - starts[u]) for u in used if u < b) for b in used}
    spans = {b: slice(first[b], first[b] + min(block, width - starts[b])) for b in used}
    mean = centre[columns]

    def products(batches):
        totals = {(i, j): np.zeros((6, spans[i].stop - spans[i].start, spans[j].stop - spans[j].start)) for i, j in strip}
        for x in _row_slices(batches, len(columns)):
            x = x - mean
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            m, q = seen.astype(float), x * x
            for (i, j), total in totals.items():
                a, b = spans[i], spans[j]
                # Where both are present: rows, sums and squares of either column, products.
                for k, (left, right) in enumerate(((m, m), (x, m), (m, x), (q, m), (m, q), (x, x))):
                    total[k] += left[:, a].T @ right[:, b]
        part = TaskContext.get().partitionId()
        for (i, j), total in totals.items():
            arrays = [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "part", "sums"])

    parts = table.select(*[f"c{c}" for c in columns]).mapInArrow(products, "i int, j int, part int, sums array<double>")
    parts = parts.select("i", "j", F.floor(F.sqrt("part")).alias("g"), array_to_vector("sums").alias("v"))
    return parts.groupBy("i", "j", "g").agg(Summarizer.sum(F.col("v")).alias("v")).drop("g")


def _correlations(sums: np.ndarray) -> np.ndarray:
    n, sx, sy, qx, qy, p = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = p - sx * sy / n
        var_x, var_y = qx - sx * sx / n, qy - sy * sy / n
        told = (var_x > 1e-14 * qx) & (var_y > 1e-14 * qy)
        return np.where(told, cov / np.sqrt(var_x * var_y), np.nan)


def scatter(
    train: DataFrame,
    test: DataFrame,
    x: str,
    y: str,
    max_points: int | None = None,
    key_cols: Sequence[str] | None = None,
    seed: int = 123,
) -> DataFrame:
    """(x, y, split) points of both sides, ``max_points`` of them at most.

    With more points exactly that many are drawn from both sides together, those of least hash. With ``key_cols`` (unique
    over both sides) the draw is a filter; without, equal points are counted and numbered first.
    """
    keys = [col(k).alias(f"__k{i}") for i, k in enumerate(key_cols or [])]
    sides = [
        side.select(col(x).alias("x"), col(y).alias("y"), F.lit(name).alias("split"), *keys)
        for name, side in (("train", train), ("test", test))
    ]
    points = sides[0].unionByName(sides[1])
    if max_points is not None:
        points = sample_rows(points, max_points, seed, [f"__k{i}" for i in range(len(keys))])
    return points.select("x", "y", "split")


def scatter_bins(train: DataFrame, test: DataFrame, x: str, y: str, bins: int = 100) -> DataFrame:
    """The scatter chart as counts per cell, for tables with too many points to draw."""
    points = scatter(train, test, x, y)
    r = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()

    def cell(c, lo, hi):
        if lo == hi:
            return F.lit(0)
        return F.least(F.floor((F.col(c) - F.lit(lo)) * F.lit(bins / (hi - lo))), F.lit(bins - 1)).cast("int")

    return (
        points.filter("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("split", cell("x", r[0], r[1]).alias("x_bin"), cell("y", r[2], r[3]).alias("y_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
