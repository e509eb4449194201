"""From a table to a ranked comparison of models."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom import learners as L
from modelloom.functions import col, content_hash
from modelloom.learners.base import WEIGHT, Fitted, Learner, encode_training, fold_equal, only_categories, predict_all
from modelloom.operators.encode import MAX_CLASSES, MAX_LEVELS, column_levels
from modelloom.operators.levels import fit_levels
from modelloom.operators.metrics import (
    METRIC_COLUMN,
    classification_metrics,
    leaderboard,
    regression_metrics,
)
from modelloom.operators.reshape import with_counter
from modelloom.operators.schema import prepare
from modelloom.operators.split import split_random, split_time

DEFAULT_LEARNERS = {
    "regression": (L.GeneralizedLinear(), L.RandomForest(), L.NeuralNetwork(), L.GradientBoosting()),
    "classification": (L.NaiveBayes(), L.RandomForest(), L.NeuralNetwork(), L.GradientBoosting()),
}
NO_IMPORTANCE = "this kind of model has no feature importance"
IMPORTANCE_SCHEMA = "model string, feature string, importance double, scaled_importance double"
TIMES_SCHEMA = "Model string, train_seconds double"
STATUS_SCHEMA = "model string, status string, message string"


@dataclass
class Comparison:
    """Trained models with their predictions, errors, importances and times."""

    task: str
    y: str
    train: DataFrame
    test: DataFrame
    models: list[Fitted]
    failures: list[tuple[str, str]] = field(default_factory=list)
    cached: bool = False

    @property
    def _spark(self):
        return self.test.sparkSession

    @property
    def labels(self) -> list[str]:
        return [m.label for m in self.models]

    @cached_property
    def predictions(self) -> DataFrame:
        """Test rows with all input columns and one column per model."""
        return predict_all(self.test, self.models)

    @cached_property
    def timings(self) -> DataFrame:
        return self._spark.createDataFrame([(m.label, round(m.seconds, 1)) for m in self.models], TIMES_SCHEMA)

    @cached_property
    def importance(self) -> DataFrame:
        rows = []
        for m in self.models:
            top = max((v for _, v in m.importance), default=0.0)
            rows += [(m.label, f, v, v / top if top > 0 else 0.0) for f, v in m.importance]
        return self._spark.createDataFrame(rows, IMPORTANCE_SCHEMA)

    @cached_property
    def metrics(self) -> DataFrame:
        if self.task == "regression":
            return regression_metrics(self.predictions, self.y, self.labels)
        features = list(self.models[0].encoder.features)
        if self.cached or not only_categories(self.test, features):
            return classification_metrics(self.predictions, self.y, self.labels)
        # Equal rows have equal predictions: one of each is scored.
        folded = predict_all(fold_equal(self.test, list(dict.fromkeys([*features, self.y]))), self.models)
        return classification_metrics(folded, self.y, self.labels, WEIGHT)

    @cached_property
    def leaderboard(self) -> DataFrame:
        return leaderboard(self.metrics, self.timings, METRIC_COLUMN[self.task])

    @cached_property
    def status(self) -> DataFrame:
        """One line per model: trained, trained without importance, or failed and why."""
        rows = [(m.label, "trained", "" if m.importance else NO_IMPORTANCE) for m in self.models]
        rows += [(label, "failed", why) for label, why in self.failures]
        return self._spark.createDataFrame(rows, STATUS_SCHEMA)

    def permutation_importance(self, key_cols: Sequence[str], seed: int = 123) -> DataFrame:
        """(model, feature, importance, scaled_importance): how much the error grows without a feature.

        Test rows are numbered in the order of a hash of their key, and each takes the
        feature's value from the row before, in turn for each feature. One join serves all
        features: every row comes once as it is and once for each feature, all are scored in one stage, and the errors
        add up by feature in the tasks. If all features are categories, equal rows are scored once. The error is that of the leaderboard, and growth below zero counts as none.
        """
        features = list(self.models[0].encoder.features)
        rows = self.test.withColumn("__hash", content_hash(seed, key_cols))
        # Rows of equal keys follow the whole row's content; only what the scoring reads is sorted and joined.
        rows = rows.withColumn("__content", F.unhex(content_hash(0, rows.columns))).withColumn("__hash", F.unhex("__hash"))
        needed = list(dict.fromkeys([*features, self.y]))
        rows = rows.select("__hash", "__content", *[col(c) for c in needed])
        numbered = with_counter(rows, ["__hash", "__content"], "__row").drop("__hash", "__content")
        n = numbered.agg(F.max("__row")).first()[0] or 0
        donors = numbered.select((F.col("__row") % n + 1).alias("__row"), *[col(f).alias(f"__d{i}") for i, f in enumerate(features)])
        which = F.explode(F.array(*[F.lit(i) for i in range(-1, len(features))])).alias("__which")
        paired, weight = numbered.join(donors, "__row").drop("__row"), F.lit(1)
        if only_categories(self.test, features):
            paired, weight = fold_equal(paired, paired.columns), F.col(WEIGHT)
        varied = paired.select("*", which)
        varied = varied.withColumns({f: F.when(F.col("__which") == i, F.col(f"__d{i}")).otherwise(col(f)) for i, f in enumerate(features)})
        scored = predict_all(varied.drop(*[f"__d{i}" for i in range(len(features))]), self.models)
        y = col(self.y)

        def error(label: str):
            p = col(label)
            if self.task == "regression":
                return F.when(F.count(p - y) == F.count(F.lit(1)), F.sqrt(F.avg(F.pow(p - y, 2))))
            wrong = F.when(p != y.cast("string"), weight).otherwise(0)
            return F.lit(100.0) * F.sum(wrong) / F.sum(weight)

        sums = scored.groupBy("__which").agg(*[error(label).alias(f"__e{i}") for i, label in enumerate(self.labels)]).collect()
        errors = {r["__which"]: {label: r[f"__e{i}"] or 0.0 for i, label in enumerate(self.labels)} for r in sums}
        none = dict.fromkeys(self.labels, 0.0)
        base, grown = errors.get(-1, none), {f: errors.get(i, none) for i, f in enumerate(features)}
        found = []
        for label in self.labels:
            values = [max(0.0, grown[f][label] - base[label]) for f in features]
            top = max(values)
            found += [(label, f, v, v / top if top > 0 else 0.0) for f, v in zip(features, values)]
        return self._spark.createDataFrame(found, IMPORTANCE_SCHEMA)

    def cache(self) -> "Comparison":
        """Keep the predictions for several reports; ``close`` lets them go."""
        self.predictions.persist(StorageLevel.MEMORY_AND_DISK)
        self.cached = True
        return self

    def close(self) -> None:
        self.predictions.unpersist()
        self.cached = False


def compare(
    train: DataFrame,
    test: DataFrame,
    y: str,
    features: Sequence[str],
    task: str,
    learners: Sequence[Learner | str] | None = None,
    parallelism: int = 1,
    key_cols: Sequence[str] | None = None,
    on_error: str = "raise",
    missing: str = "skip",
    max_levels: int = MAX_LEVELS,
    max_classes: int = MAX_CLASSES,
    target_encode: Sequence[str] = (),
) -> Comparison:
    """Train any set of learners on one encoded, cached training table.

    Learners are given as objects, or by name for their default parameters.
    ``on_error='keep'`` goes on when a learner fails and reports it in ``status``;
    ``missing='error'`` refuses training rows with missing values. Predictors in
    ``target_encode`` may have any number of levels: their frequency and target means
    stand for them, as columns beside theirs in both tables (``key_cols`` are needed for the folds).
    """
    if task not in DEFAULT_LEARNERS:
        raise ValueError(f"task must be one of {tuple(DEFAULT_LEARNERS)}, not {task!r}")
    chosen = list(DEFAULT_LEARNERS[task] if learners is None else learners)
    chosen = [L.learner(c) if isinstance(c, str) else c for c in chosen]
    if not chosen:
        raise ValueError("choose at least one learner")
    if not features:
        raise ValueError("no predictor selected")
    if on_error not in ("raise", "keep"):
        raise ValueError("on_error must be 'raise' or 'keep'")
    clash = sorted({c.label for c in chosen} & set(test.columns))
    if clash:
        raise ValueError(f"model labels are already columns of the table: {clash}")
    for learner in chosen:
        if task not in learner.tasks:
            raise ValueError(f"{learner.label} does not serve {task}")
    if target_encode:
        train, test, features = _encode_levels(train, test, y, task, features, key_cols, target_encode, max_classes)
    data = encode_training(train, y, task, features, key_cols, learners=chosen, missing=missing, max_levels=max_levels, max_classes=max_classes)

    def run(learner: Learner):
        try:
            return learner.fit(data)
        except Exception as error:
            if on_error == "raise":
                raise
            return learner.label, f"{type(error).__name__}: {error}"

    try:
        if parallelism > 1:
            with ThreadPoolExecutor(parallelism) as pool:
                outcomes = list(pool.map(inheritable_thread_target(train.sparkSession)(run), chosen))
        else:
            outcomes = [run(c) for c in chosen]
    finally:
        data.release()
        if target_encode:
            train.unpersist()
    models = [o for o in outcomes if isinstance(o, Fitted)]
    failures = [o for o in outcomes if not isinstance(o, Fitted)]
    if not models:
        raise RuntimeError(f"no learner could be trained: {failures}")
    return Comparison(task, y, train, test, models, failures)


def _encode_levels(train, test, y, task, features, key_cols, names, max_classes):
    """Both tables with the encoded columns, and the predictors with these in place of ``names``."""
    if not key_cols:
        raise ValueError("target_encode needs key_cols, which deal the rows to folds")
    unknown = [n for n in names if n not in features]
    if unknown:
        raise ValueError(f"target_encode names no predictors: {unknown}")
    classes = column_levels(train, [y], [max_classes])[0] if task == "classification" else None
    table = fit_levels(train, names, y, key_cols, classes)
    features = [f for f in features if f not in names] + table.encoded_names
    # Several passes are made over the joined rows.
    return table.encode(train, fitting=True).persist(StorageLevel.MEMORY_AND_DISK), table.encode(test), features


def _run(data, y, task, features, learners, share, seed, key_cols, time_col, cut, start, end, **options):
    df, roles = prepare(data, y, task, features, time_col)
    if roles.time_col is not None:
        train, test = split_time(df, roles.time_col, cut, start, end)
    else:
        train, test = split_random(df, share, seed, key_cols)
    return compare(train, test, roles.y, roles.features, task, learners, key_cols=key_cols, **options)


def regression(
    data: DataFrame,
    y: str,
    features: Sequence[str] | None = None,
    learners: Sequence[Learner | str] | None = None,
    share: str | float = "70%",
    seed: int = 123,
    key_cols: Sequence[str] | None = None,
    time_col: str | None = "auto",
    cut=None,
    start=None,
    end=None,
    **options,
) -> Comparison:
    """Compare regression models for a numeric target.

    A table with a date or timestamp column is split along it, others at random.
    ``options`` are those of ``compare``: ``parallelism``, ``on_error``, ``missing``,
    ``max_levels``, ``max_classes``, ``target_encode``.
    """
    return _run(data, y, "regression", features, learners, share, seed, key_cols, time_col, cut, start, end, **options)


def classification(
    data: DataFrame,
    y: str,
    features: Sequence[str] | None = None,
    learners: Sequence[Learner | str] | None = None,
    share: str | float = "70%",
    seed: int = 123,
    key_cols: Sequence[str] | None = None,
    time_col: str | None = "auto",
    cut=None,
    start=None,
    end=None,
    **options,
) -> Comparison:
    """Compare classification models; the target is taken as categories.

    Splits and ``options`` are those of ``regression``.
    """
    return _run(data, y, "classification", features, learners, share, seed, key_cols, time_col, cut, start, end, **options)
