"""Predictor columns to model vectors.

One encoder serves all models of a comparison. It offers two layouts: ``linear``
(categories as 0/1 columns, first level as base) and ``tree`` (categories as
level numbers). Without categories one column serves as both.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelloom.functions import col, epoch_micros, field, is_numeric, is_time

LINEAR, TREE, LABEL, OK = "__linear", "__tree", "__label", "__ok"
MAX_LEVELS = 10_000
MAX_CLASSES = 1_000


@dataclass(frozen=True)
class Encoder:
    features: tuple[str, ...]
    numbers: tuple[str, ...]
    arrays: dict[str, int]
    categories: tuple[str, ...]
    levels: tuple[tuple[str, ...], ...]
    indexers: tuple
    one_hot: object | None

    @property
    def tree_names(self) -> list[str]:
        wide = [f"{a}_{i}" for a, size in self.arrays.items() for i in range(size)]
        return [*self.numbers, *wide, *self.categories]

    @property
    def linear_names(self) -> list[str]:
        """Slot names of the linear layout; a category's slots share its name."""
        slots = [c for c, values in zip(self.categories, self.levels) for _ in values[1:]]
        wide = [f"{a}_{i}" for a, size in self.arrays.items() for i in range(size)]
        return [*self.numbers, *wide, *slots]

    @property
    def linear(self) -> str:
        """The column of the linear layout: without categories both layouts are one."""
        return LINEAR if self.categories else TREE

    @property
    def n_tree_numbers(self) -> int:
        return len(self.tree_names) - len(self.categories)

    @property
    def max_levels(self) -> int:
        return max((len(v) for v in self.levels), default=0)

    def complete(self, df: DataFrame):
        """True where every predictor is present. Flat however many predictors there are."""
        checks = [F.lit(True)]
        if self.numbers:
            checks.append(F.forall(self._numbers(df), lambda v: v.isNotNull() & ~F.isnan(v)))
        if self.categories:
            checks.append(F.forall(F.array(*[col(c).cast("string") for c in self.categories]), lambda v: v.isNotNull()))
        for name, size in self.arrays.items():
            checks.append(col(name).isNotNull() & (F.size(col(name)) == F.lit(size)))
            checks.append(F.forall(col(name).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v)))
        return F.coalesce(F.forall(F.array(*checks), lambda v: v), F.lit(False))

    def _numbers(self, df: DataFrame):
        return F.array(*[_as_number(df, name) for name in self.numbers])

    def transform(self, df: DataFrame, fitting: bool = False) -> DataFrame:
        """Adds the vector columns and ``__ok``.

        ``__ok`` is false where a predictor is missing or holds a level unseen in
        training; models give no prediction there.
        """
        complete = self.complete(df)
        out = df.filter(complete) if fitting else df.withColumn(OK, complete)
        vectors, sizes = {}, {}
        if self.numbers:
            values = self._numbers(df)
            vectors["__n"] = values if fitting else F.transform(values, lambda v: F.coalesce(v, F.lit(0.0)))
            sizes["__n"] = len(self.numbers)
        for i, (name, size) in enumerate(self.arrays.items()):
            values = col(name).cast("array<double>")
            if not fitting:
                values = F.when(F.col(OK), values).otherwise(F.array_repeat(F.lit(0.0), size))
            vectors[f"__a{i}"], sizes[f"__a{i}"] = values, size
        inputs = list(vectors)
        texts = {f"__s{i}": col(name).cast("string") for i, name in enumerate(self.categories)}
        # One projection for all inputs, so that the plan is as deep for many predictors as for few.
        out = out.withColumns({n: array_to_vector(v) for n, v in vectors.items()} | texts)
        for name, size in sizes.items():
            out = VectorSizeHint(inputCol=name, size=size, handleInvalid="optimistic").transform(out)
        index = [f"__i{i}" for i in range(len(self.categories))]
        # A category with a single level has no 0/1 column beside its base.
        hot = [f"__h{i}" for i, values in enumerate(self.levels) if len(values) > 1]
        if self.categories:
            for indexer in self.indexers:
                out = indexer.copy().setHandleInvalid("error" if fitting else "keep").transform(out)
            if not fitting:
                known = [F.col(n) < F.lit(len(v)) for n, v in zip(index, self.levels)]
                all_known = F.forall(F.array(*known), lambda v: v)
                first = {n: F.when(k, F.col(n)).otherwise(F.lit(0.0)) for n, k in zip(index, known)}
                out = out.withColumns({OK: F.col(OK) & all_known} | first)
            if hot:
                out = self.one_hot.transform(out)
            out = VectorAssembler(inputCols=[*inputs, *hot], outputCol=LINEAR, handleInvalid="keep").transform(out)
        out = VectorAssembler(inputCols=[*inputs, *index], outputCol=TREE, handleInvalid="keep").transform(out)
        return out.drop(*inputs, *index, *hot, *texts)


def _as_number(df: DataFrame, name: str):
    dtype = field(df, name).dataType
    if is_time(dtype):
        return epoch_micros(df, name) / F.lit(1e6)
    return col(name).cast("double")


def column_levels(df: DataFrame, names: Sequence[str], limits: Sequence[int]) -> list[tuple[str, ...]]:
    """The sorted levels of several columns from one pass.

    Repeats fold away before the shuffle. Levels are held on the driver, so a
    column with more than its limit (an identifier, most likely) is refused; at
    most one row per allowed level and column is collected to find that out.
    """
    cells = [F.struct(F.lit(i).alias("i"), col(n).cast("string").alias("v")) for i, n in enumerate(names)]
    levels = df.select(F.inline(F.array(*cells))).filter("v IS NOT NULL").distinct()
    found: list[list[str]] = [[] for _ in names]
    for row in levels.limit(sum(limits) + len(names)).collect():
        found[row["i"]].append(row["v"])
    for name, values, limit in zip(names, found, limits):
        if len(values) > limit:
            raise ValueError(f"column {name!r} has more than {limit} levels; drop it, group its levels or have it target encoded")
    return [tuple(sorted(v)) for v in found]


def fit_encoder(
    df: DataFrame,
    features: Sequence[str],
    max_levels: int = MAX_LEVELS,
    target: str | None = None,
    max_classes: int = MAX_CLASSES,
) -> tuple[Encoder, tuple[str, ...]]:
    """Learn category levels and array lengths from the complete training rows.

    With ``target`` its classes are learnt in the same pass and returned beside
    the encoder. Arrays of a column must all have one length; ``max_levels`` and
    ``max_classes`` bound what the driver holds.
    """
    numbers, arrays, categories = [], [], []
    for name in features:
        dtype = field(df, name).dataType
        if is_numeric(dtype) or is_time(dtype):
            numbers.append(name)
        elif isinstance(dtype, T.ArrayType) and is_numeric(dtype.elementType):
            arrays.append(name)
        elif isinstance(dtype, (T.StringType, T.BooleanType)):
            categories.append(name)
        else:
            raise TypeError(f"column {name!r} of type {dtype.simpleString()} cannot be a predictor")
    sizes = {}
    if arrays:
        ends = [f(F.when(col(a).isNotNull(), F.size(col(a)))) for a in arrays for f in (F.min, F.max)]
        row = df.agg(*ends).first()
        for i, name in enumerate(arrays):
            low, high = row[2 * i], row[2 * i + 1]
            if low != high:
                raise ValueError(f"arrays in column {name!r} have {low} to {high} elements; they must have one length")
            sizes[name] = high or 0
    base = Encoder(tuple(features), tuple(numbers), sizes, tuple(categories), (), (), None)
    names = [*categories, *([] if target is None else [target])]
    if not names:
        return base, ()
    limits = [max_levels] * len(categories) + [max_classes] * (target is not None)
    levels = column_levels(df.filter(base.complete(df)), names, limits)
    classes = levels.pop() if target is not None else ()
    if not categories:
        return base, classes
    varied = [i for i, values in enumerate(levels) if len(values) > 1]
    if not (numbers or arrays or varied):
        raise ValueError("every predictor has a single level")
    # Falling order puts the first level last, where one-hot encoding drops it.
    indexers = tuple(
        StringIndexerModel.from_labels(list(reversed(values)), f"__s{i}", f"__i{i}") for i, values in enumerate(levels)
    )
    one_hot = None
    if varied:
        # The level counts are in the index columns' metadata, so no row is read.
        indexed = df.limit(0).select(*[col(c).cast("string").alias(f"__s{i}") for i, c in enumerate(categories)])
        for indexer in indexers:
            indexed = indexer.transform(indexed)
        one_hot = OneHotEncoder(
            inputCols=[f"__i{i}" for i in varied], outputCols=[f"__h{i}" for i in varied], dropLast=True
        ).fit(indexed)
    return Encoder(tuple(features), tuple(numbers), sizes, tuple(categories), tuple(levels), indexers, one_hot), classes
