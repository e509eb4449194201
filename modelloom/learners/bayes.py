"""Naive Bayes over mixed predictors, and MLlib's variants."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import NaiveBayes as SparkNaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.learners import names
from modelloom.learners.base import Learner, TrainingData, mllib_score, param
from modelloom.operators.encode import LABEL, TREE


@dataclass(frozen=True)
class BayesTables:
    """Per class: log prior, mean and deviation per number, log share per level."""

    log_prior: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    log_share: tuple[np.ndarray, ...]
    counts: np.ndarray


@dataclass(frozen=True)
class NaiveBayes(Learner):
    """Gaussian for numbers, counted shares with Laplace smoothing for categories.

    Deviations up to ``eps_sdev`` become ``min_sdev``; shares of zero become
    ``min_prob``.
    """

    label = names.NAIVE_BAYES
    tasks = ("classification",)
    layouts = ("tree",)

    laplace: float = param(0.0, 0, 10)
    min_sdev: float = param(0.01, 1e-10, 1e6)
    eps_sdev: float = param(0.01, 0, 1e6)
    min_prob: float = param(0.001, 1e-10, 1)

    def rows_apart(self) -> int:
        return 1

    def _fit(self, data: TrainingData):
        tables, numbers = self._tables(data), data.encoder.n_tree_numbers

        def score(df: DataFrame, name: str) -> DataFrame:
            return _score(df, name, vector_to_array(TREE), tables, numbers)

        return score, (), tables

    def _tables(self, data: TrainingData) -> BayesTables:
        encoder, classes = data.encoder, len(data.classes)
        numbers = encoder.n_tree_numbers
        summary = Summarizer.metrics("mean", "variance").summary(F.col(TREE))
        rows = data.df.groupBy(LABEL).agg(summary.alias("s"), F.sum(data.weight).alias("n")).collect()
        mean, sd, counts = np.zeros((classes, numbers)), np.ones((classes, numbers)), np.zeros(classes)
        for r in rows:
            k = int(r[LABEL])
            counts[k] = r["n"]
            mean[k] = r["s"]["mean"].toArray()[:numbers]
            sd[k] = np.sqrt(np.maximum(r["s"]["variance"].toArray()[:numbers], 0.0))
        sd = np.where(sd <= self.eps_sdev, self.min_sdev, sd)
        shares = []
        if encoder.categories:
            level = F.slice(vector_to_array(TREE), numbers + 1, len(encoder.categories))
            # Classes x predictors x levels groups, folded per task before the shuffle.
            seen = (
                data.df.select(LABEL, data.weight.alias("w"), F.posexplode(level).alias("j", "level"))
                .groupBy(LABEL, "j", "level")
                .agg(F.sum("w").alias("n"))
                .collect()
            )
            found = [np.zeros((classes, len(v))) for v in encoder.levels]
            for r in seen:
                # Level numbers of the encoder run from the last level to the first.
                found[r["j"]][int(r[LABEL]), int(r["level"])] = r["n"]
            for table in found:
                share = (table + self.laplace) / (counts[:, None] + self.laplace * table.shape[1])
                shares.append(np.log(np.where(share <= 0, self.min_prob, share)))
        return BayesTables(np.log(counts / counts.sum()), mean, sd, tuple(shares), counts)


def _score(df: DataFrame, name: str, x, t: BayesTables, numbers: int) -> DataFrame:
    """The likeliest class, in Arrow batches. Equal scores go to the first class.

    Values are centred before they are squared, so that large ones do not cancel.
    What is broadcast grows with classes, predictors and levels, which are bounded by
    ``max_classes`` and ``max_levels``.
    """
    shared = df.sparkSession.sparkContext.broadcast((t.log_prior, t.mean, t.sd, t.log_share))

    @F.pandas_udf("double")
    def best(column: pd.Series) -> pd.Series:
        log_prior, mean, sd, log_share = shared.value
        rows = np.stack(column.to_numpy())
        total = np.empty((len(rows), len(log_prior)))
        for k in range(len(log_prior)):
            z = (rows[:, :numbers] - mean[k]) / sd[k]
            total[:, k] = log_prior[k] - np.log(sd[k]).sum() - 0.5 * (z * z).sum(axis=1)
        for j, share in enumerate(log_share):
            total += share.T[rows[:, numbers + j].astype(int)]
        return pd.Series(total.argmax(axis=1).astype(float))

    return df.withColumn(name, best(x))


@dataclass(frozen=True)
class MLlibNaiveBayes(Learner):
    """MLlib's naive Bayes; ``multinomial`` and ``complement`` need values >= 0."""

    label = names.NAIVE_BAYES
    tasks = ("classification",)
    layouts = ("linear",)

    smoothing: float = param(1.0, 0, 10)
    model_type: str = param("multinomial", choices=("multinomial", "complement", "bernoulli", "gaussian"))

    def _fit(self, data: TrainingData):
        if self.model_type in ("multinomial", "complement"):
            low = data.df.agg(Summarizer.min(F.col(data.encoder.linear)).alias("m")).first()["m"].toArray()
            if (low < 0).any():
                raise ValueError(
                    f"{self.model_type} naive Bayes needs values >= 0; use model_type='gaussian' or the NaiveBayes learner"
                )
        model = SparkNaiveBayes(
            featuresCol=data.encoder.linear, labelCol=LABEL, smoothing=self.smoothing, modelType=self.model_type
        ).fit(data.df)
        return mllib_score(model), (), model
