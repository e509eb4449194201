"""What all learners share: parameters with ranges, training data, scoring."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark import StorageLevel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelloom.functions import col, content_hash
from modelloom.functions import field as field_of
from modelloom.operators.encode import LABEL, LINEAR, MAX_CLASSES, MAX_LEVELS, OK, TREE, Encoder, fit_encoder

RAW, KEY, WEIGHT = "__raw", "__key", "__weight"
ROWS_PER_PARTITION = 100_000
KEY_BITS = 60  # of a row's key hash, a number from 0 on


def param(default, low=None, high=None, choices=None):
    """A learner parameter with its default and what it may be."""
    return field(default=default, metadata={"low": low, "high": high, "choices": choices})


@dataclass(frozen=True)
class TrainingData:
    """Encoded training rows, cached once for all learners.

    If ``folded``, a row stands for as many equal ones as its weight says.
    """

    df: DataFrame
    encoder: Encoder
    task: str
    classes: tuple[str, ...]
    folded: bool = False

    @property
    def weight(self):
        return F.col(WEIGHT) if self.folded else F.lit(1.0)

    def release(self) -> None:
        self.df.unpersist()


def encode_training(
    train: DataFrame,
    y: str,
    task: str,
    features: Sequence[str],
    key_cols: Sequence[str] | None = None,
    partitions: int | None = None,
    learners: Sequence["Learner"] = (),
    missing: str = "skip",
    max_levels: int = MAX_LEVELS,
    max_classes: int = MAX_CLASSES,
) -> TrainingData:
    """Encode the complete training rows and cache them.

    Rows are dealt out evenly; their number alone says into how many partitions.
    With ``key_cols`` (unique per row) they are dealt by key, so that seeded
    learners, whose draws follow row positions, give the same model for the same
    rows however the input was partitioned and whatever the cluster. ``learners``
    limits the cached vectors to the layouts those need. ``missing='error'`` refuses
    incomplete rows instead of leaving them out. The cache is filled here, so that
    no learner's time holds the encoding.

    If all predictors of a classification are categories and all ``learners`` take weights,
    equal rows fold into few weighted ones, so that a fit does not grow with the rows.
    """
    if missing not in ("skip", "error"):
        raise ValueError("missing must be 'skip' or 'error'")
    if missing == "error":
        _refuse_incomplete(train, [*features, y])
    train = train.filter(col(y).isNotNull())
    if task == "regression":
        train = train.filter(~F.isnan(col(y).cast("double")))
    apart = _rows_apart(train, task, features, learners)
    if apart:
        key_cols = list(dict.fromkeys([*features, y]))
        # As text, which tells 0.0 from -0.0 like the classes do.
        groups = fold_equal(train.withColumn(y, col(y).cast("string")), key_cols).persist(StorageLevel.MEMORY_AND_DISK)
        train = _with_weights(groups, apart)
    encoder, classes = fit_encoder(
        train, features, max_levels, target=y if task == "classification" else None, max_classes=max_classes
    )
    train = _lay_out(train, key_cols, partitions)
    # Folds of a search follow the key, or else the row's content.
    train = train.withColumn(KEY, F.conv(F.substring(content_hash(0, key_cols or [*features, y]), 1, KEY_BITS // 4), 16, 10).cast("long"))
    if task == "regression":
        train = train.withColumn(LABEL, col(y).cast("double"))
    else:
        # Classes seen in incomplete rows only are skipped along with those rows.
        indexer = StringIndexerModel.from_labels(list(classes), inputCol="__y", outputCol=LABEL, handleInvalid="skip")
        train = indexer.transform(train.withColumn("__y", col(y).cast("string"))).drop("__y")
    names = {"linear": encoder.linear, "tree": TREE}
    layouts = {v for learner in learners for v in learner.layouts} or set(names)
    vectors = sorted({names[v] for v in layouts})
    kept = [LABEL, KEY, *vectors, *([WEIGHT] if apart else [])]
    encoded = encoder.transform(train, fitting=True).select(*kept).persist(StorageLevel.MEMORY_AND_DISK)
    encoded.count()
    if apart:
        groups.unpersist()
    return TrainingData(encoded, encoder, task, classes, apart > 0)


def only_categories(df: DataFrame, features: Sequence[str]) -> bool:
    return all(isinstance(field_of(df, f).dataType, (T.StringType, T.BooleanType)) for f in features)


def fold_equal(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row for each combination of the columns ``names``, with the number of rows as ``__weight``."""
    return df.groupBy(*[col(n) for n in names]).agg(F.count(F.lit(1)).alias(WEIGHT))


def _rows_apart(train: DataFrame, task: str, features: Sequence[str], learners: Sequence["Learner"]) -> int:
    """As how many weighted rows equal ones go to the learners; 0 if some learner needs them all."""
    if task != "classification" or not learners or not only_categories(train, features):
        return 0
    wanted = [learner.rows_apart() for learner in learners]
    return max(wanted) if all(wanted) else 0


def _with_weights(groups: DataFrame, apart: int) -> DataFrame:
    """Each group as up to ``apart`` rows that share its weight."""
    n = F.least(F.col(WEIGHT), F.lit(apart))
    return groups.withColumns({"__n": F.explode(F.sequence(F.lit(1), n)), WEIGHT: F.col(WEIGHT) / n}).drop("__n")


def _refuse_incomplete(train: DataFrame, names: Sequence[str]) -> None:
    row = train.agg(F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    gaps = {c: row["n"] - row[f"n{i}"] for i, c in enumerate(names) if row[f"n{i}"] < row["n"]}
    if gaps:
        raise ValueError(f"missing values per column: {gaps}")


def _lay_out(train: DataFrame, key_cols: Sequence[str] | None, partitions: int | None) -> DataFrame:
    """Training rows in even partitions, by key if there is one.

    Learners pass over these rows dozens of times and each pass waits for the
    largest partition.
    """
    wanted = partitions or max(1, -(-train.count() // ROWS_PER_PARTITION))
    if key_cols:
        keys = [col(c) for c in key_cols]
        return train.repartition(wanted, *keys).sortWithinPartitions(*keys)
    return train.repartition(wanted)


@dataclass(frozen=True)
class Fitted:
    """A trained model that can add its prediction column to encoded rows.

    ``score(df, name)`` adds the raw prediction: a number, or a class index.
    """

    label: str
    learner: "Learner"
    data: TrainingData
    seconds: float
    score: Callable[[DataFrame, str], DataFrame]
    importance: tuple[tuple[str, float], ...] = ()
    model: object = None

    @property
    def encoder(self) -> Encoder:
        return self.data.encoder

    def add_prediction(self, encoded: DataFrame, digits: int | None = 3) -> DataFrame:
        out = self.score(encoded, RAW)
        if self.data.task == "regression":
            value = F.col(RAW) if digits is None else F.round(F.col(RAW), digits)
        else:
            value = F.element_at(F.lit(list(self.data.classes)), F.col(RAW).cast("int") + 1)
        return out.withColumn(self.label, F.when(F.col(OK), value)).drop(RAW)


@dataclass(frozen=True)
class Learner:
    """A learner's parameters. Subclasses say which tasks they serve and how to fit."""

    label = ""
    tasks = ()
    layouts = ("linear", "tree")

    def __post_init__(self):
        for f in fields(self):
            low, high, choices = (f.metadata.get(k) for k in ("low", "high", "choices"))
            value = getattr(self, f.name)
            if choices is not None and value not in choices:
                raise ValueError(f"{f.name} must be one of {choices}, not {value!r}")
            if low is not None and not low <= value <= high:
                raise ValueError(f"{f.name} must lie in [{low}, {high}], not {value!r}")

    def fit(self, data: TrainingData) -> Fitted:
        if data.task not in self.tasks:
            raise ValueError(f"{self.label} does not serve {data.task}")
        started = time.perf_counter()
        score, importance, model = self._fit(data)
        return Fitted(self.label, self, data, time.perf_counter() - started, score, tuple(importance), model)

    def rows_apart(self) -> int:
        """How many of any number of equal rows the fit must see, with their weights; 0 if all, as it draws rows."""
        return 0

    def _fit(self, data: TrainingData):
        raise NotImplementedError

    def with_params(self, **changes) -> "Learner":
        return replace(self, **changes)


def train_model(
    train: DataFrame,
    y: str,
    task: str,
    features: Sequence[str],
    learner: Learner,
    key_cols: Sequence[str] | None = None,
    max_levels: int = MAX_LEVELS,
    max_classes: int = MAX_CLASSES,
) -> Fitted:
    """Train one learner and let go of the cached rows; predictions do not need them."""
    data = encode_training(
        train, y, task, features, key_cols, learners=[learner], max_levels=max_levels, max_classes=max_classes
    )
    try:
        return learner.fit(data)
    finally:
        data.release()


def mllib_score(model) -> Callable[[DataFrame, str], DataFrame]:
    """Scoring by a fitted MLlib model, without its helper columns."""

    def score(df: DataFrame, name: str) -> DataFrame:
        quiet = model.copy({model.predictionCol: name})
        for p in ("rawPredictionCol", "probabilityCol"):
            if quiet.hasParam(p):
                quiet = quiet.copy({quiet.getParam(p): ""})
        return quiet.transform(df)

    return score


def predict_all(test: DataFrame, models: Sequence[Fitted], digits: int | None = 3) -> DataFrame:
    """Test rows with one prediction column per model, named by the model's label.

    Models are chained on the same rows, never joined by position. Numbers are
    rounded to three decimals; classes come as their names.
    """
    labels = [m.label for m in models]
    taken = sorted(set(labels) & set(test.columns))
    if taken:
        raise ValueError(f"model labels are already columns of the table: {taken}")
    if len(set(labels)) < len(labels):
        raise ValueError(f"model labels repeat: {labels}")
    out, current = test, None
    for m in models:
        if m.encoder is not current:
            out = m.encoder.transform(out.drop(LINEAR, TREE, OK))
            current = m.encoder
        out = m.add_prediction(out, digits)
    return out.select(*[col(c) for c in [*test.columns, *labels]])
