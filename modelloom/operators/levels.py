"""Encoding of categories with any number of levels by their frequency and target means.

Levels stay a DataFrame from the count to the join; the driver sees totals only. A training row is
encoded without the rows of its own fold, so that a level with few rows does not give
its target away; other rows are encoded by all training rows. Levels with more than a
thousandth of the rows, of which there can't be more than a thousand a column, are joined as a broadcast
table, so no key of the shuffled join is hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelloom.functions import col, content_hash, field
from modelloom.session import ensure_checkpoint_dir

#: Share of the rows above which a level's table row is broadcast.
HOT_SHARE = 0.001
LEVEL, FOLD = "__level", "__fold"


@dataclass(frozen=True)
class LevelTable:
    """Counts and target sums by column, level and fold, as a table of one row per column and level.

    ``levels(feature, level, n, s, folds map<fold, struct<n, s>>)``; ``s`` has one sum per output: the target itself, or for a
    class target the rows of each class but the first.
    """

    levels: DataFrame
    features: tuple[str, ...]
    outputs: tuple[str, ...]
    rows: int
    prior: tuple[float, ...]
    folds: int
    seed: int
    key_cols: tuple[str, ...]
    smoothing: float

    def names(self, feature: str) -> list[str]:
        """The columns that stand for a category."""
        return [f"{feature}_freq", *(f"{feature}_{o}" for o in self.outputs)]

    @property
    def encoded_names(self) -> list[str]:
        return [n for f in self.features for n in self.names(f)]

    def encode(self, df: DataFrame, fitting: bool = False) -> DataFrame:
        """``df`` with the encoded columns of every feature after its own.

        ``fitting`` is for the training rows: the row's own fold does not count. Null is a level of its own. Levels that
        were not seen have frequency 0 and the mean of all rows.
        """
        clash = sorted({n.lower() for n in self.encoded_names} & {c.lower() for c in df.columns})
        if clash:
            raise ValueError(f"encoded columns are already columns of the table: {clash}")
        out = df.withColumn(FOLD, fold_of(self.key_cols, self.seed, self.folds)) if fitting else df
        for feature in self.features:
            out = self._join(out, feature, fitting)
        return out.drop(FOLD)

    def _join(self, df: DataFrame, feature: str, fitting: bool) -> DataFrame:
        own = self.levels.where(F.col("feature") == feature)
        own = own.select(F.col("level").alias("__lv"), F.struct("n", "s", "folds").alias("__stats"))
        least = self.rows * HOT_SHARE
        # Proven: at most 1 / HOT_SHARE levels have more rows than that.
        hot = F.broadcast(own.where(F.col("__stats.n") > least).select(F.col("__lv").alias("__hot_lv"), F.col("__stats").alias("__hot")))
        cold = own.where(F.col("__stats.n") <= least).select(F.lit(False).alias("__is_hot"), "__lv", F.col("__stats").alias("__cold"))
        level = level_text(df, feature)
        found = df.withColumn(LEVEL, level).join(hot, F.col(LEVEL) == F.col("__hot_lv"), "left")
        is_hot = F.col("__hot").isNotNull()
        # Rows that have their level already get spread-out keys that match nothing.
        spread = F.when(is_hot, F.monotonically_increasing_id().cast("string")).otherwise(F.col(LEVEL))
        found = found.withColumns({"__is_hot": is_hot, "__lv": spread}).join(cold, ["__is_hot", "__lv"], "left")
        stats = F.coalesce("__hot", "__cold")
        n, sums = F.coalesce(stats["n"], F.lit(0)), stats["s"]
        left_n, total = n, F.lit(self.rows)
        if fitting:
            part = F.element_at(stats["folds"], F.col(FOLD))
            left_n = n - F.coalesce(part["n"], F.lit(0))
        values = [(left_n / total).alias(self.names(feature)[0])] if self.rows else [F.lit(0.0).alias(self.names(feature)[0])]
        for i, (name, prior) in enumerate(zip(self.names(feature)[1:], self.prior, strict=True)):
            mine = F.coalesce(sums[i], F.lit(0.0))
            if fitting:
                mine = mine - F.coalesce(part["s"][i], F.lit(0.0))
            weight = left_n + F.lit(float(self.smoothing))
            mean = F.when(weight > 0, (mine + F.lit(self.smoothing * prior)) / weight).otherwise(F.lit(prior))
            values.append(F.when(left_n > 0, mean).otherwise(F.lit(prior)).alias(name))
        return found.select(*[col(c) for c in df.columns], *values)


def level_text(df: DataFrame, name: str) -> Column:
    """A level as text, apart from null."""
    return F.coalesce(F.concat(F.lit("="), col(name).cast("string")), F.lit("null"))


def fold_of(key_cols: Sequence[str], seed: int, folds: int) -> Column:
    """The fold of a row by the md5 of its key: the same however the table is partitioned."""
    return (F.conv(F.substring(content_hash(seed, key_cols), 1, 8), 16, 10).cast("long") % F.lit(folds)).cast("int")


def fit_levels(
    train: DataFrame,
    features: Sequence[str],
    y: str,
    key_cols: Sequence[str],
    classes: Sequence[str] | None = None,
    folds: int = 5,
    smoothing: float = 10.0,
    seed: int = 123,
) -> LevelTable:
    """Count the levels of ``features`` and add up their targets in one pass over ``train``.

    Rows without a target are left out. ``smoothing`` rows of the overall mean are mixed into every level's
    mean. With ``classes`` the target is a category and each class but the first gives a column of
    shares. Rows with equal keys share a fold. Repeats fold away in each task, so frequent levels are
    no hot keys. The table is checkpointed: later passes read it.
    """
    for name in [*features, y, *key_cols]:
        field(train, name)
    if not features:
        raise ValueError("no category to encode")
    if folds < 2 or smoothing < 0:
        raise ValueError("folds must be at least 2 and smoothing at least 0")
    ensure_checkpoint_dir(train.sparkSession)
    rows = train.where(col(y).isNotNull())
    if classes is None:
        rows = rows.where(~F.isnan(col(y).cast("double")))
        outputs, targets = ("mean",), [col(y).cast("double")]
    else:
        outputs = tuple(f"share_{c}" for c in list(classes)[1:])
        targets = [(col(y).cast("string") == F.lit(c)).cast("double") for c in list(classes)[1:]]
    cells = [F.struct(F.lit(f).alias("feature"), level_text(train, f).alias("level")) for f in features]
    long = rows.select(fold_of(key_cols, seed, folds).alias("fold"), *[t.alias(f"t{i}") for i, t in enumerate(targets)], F.explode(F.array(*cells)).alias("c"))
    sums = F.array(*[F.sum(f"t{i}") for i in range(len(targets))]) if targets else F.array().cast("array<double>")
    by_fold = long.groupBy("c.feature", "c.level", "fold").agg(F.count(F.lit(1)).alias("n"), sums.alias("s"))
    entry = F.struct("fold", F.struct("n", "s"))
    # A level has one row per fold here, so nothing unbounded is collected.
    totals = F.array(*[F.sum(F.col("s")[i]) for i in range(len(targets))]) if targets else F.array().cast("array<double>")
    levels = by_fold.groupBy("feature", "level").agg(
        F.sum("n").alias("n"), totals.alias("s"), F.map_from_entries(F.collect_list(entry)).alias("folds")
    ).checkpoint()
    first = levels.where(F.col("feature") == features[0]).agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(len(targets))]).first()
    n = first["n"] or 0
    prior = tuple((first[f"s{i}"] / n) if n else 0.0 for i in range(len(targets)))
    return LevelTable(levels, tuple(features), outputs, n, prior, folds, seed, tuple(key_cols), smoothing)
