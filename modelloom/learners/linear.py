"""Linear, generalized linear and logistic models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vector, Vectors
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from modelloom.functions.vectors import sum_vectors
from modelloom.learners import names
from modelloom.learners.base import WEIGHT, Learner, TrainingData, mllib_score, param
from modelloom.operators.encode import LABEL

_SCALED = "__scaled"
MLLIB_GLM_COLUMNS = 4096  # what GeneralizedLinearRegression takes
GRAM_COLUMNS = 1000  # up to which a matrix of columns by columns is added up for penalised fits


@dataclass(frozen=True)
class PenalisedModel:
    """Coefficients in the predictors' own units; ``standardised`` ends with the intercept at the predictors' means."""

    coefficients: Vector
    intercept: float
    standardised: np.ndarray
    passes: int


def _coordinate_descent(gram: np.ndarray, n: int, lasso: float, ridge: float, intercept: bool, shift: np.ndarray, start) -> np.ndarray:
    """Coefficients and intercept that minimise the weighted squares / (2 n) and the penalties.

    ``gram`` is over (x, z, 1). Without an intercept the line goes through the origin of the
    predictors before they were centred by ``shift``.
    """
    p = len(gram) - 2
    total, x_sum, z_sum = gram[-1, -1], gram[-1, :p], gram[-1, p]
    if intercept:
        square = (gram[:p, :p] - np.outer(x_sum, x_sum) / total) / n
        cross = (gram[:p, p] - x_sum * z_sum / total) / n
    else:
        square = (gram[:p, :p] + np.outer(shift, x_sum) + np.outer(x_sum, shift) + total * np.outer(shift, shift)) / n
        cross = (gram[:p, p] + shift * z_sum) / n
    beta = np.zeros(p) if start is None else start[:-1].copy()
    left = cross - square @ beta
    for _ in range(10_000):
        moved = 0.0
        for j in range(p):
            own = square[j, j]
            if own <= 0 or own + ridge <= 0:
                continue
            pull = left[j] + own * beta[j]
            new = np.sign(pull) * max(abs(pull) - lasso, 0.0) / (own + ridge)
            step = new - beta[j]
            if step:
                left -= square[:, j] * step
                beta[j] = new
                moved = max(moved, abs(step))
        if moved <= 1e-12 * max(1.0, np.abs(beta).max(initial=0.0)):
            break
    constant = (z_sum - x_sum @ beta) / total if intercept else shift @ beta
    return np.append(beta, constant)


@dataclass(frozen=True)
class GeneralizedLinear(Learner):
    """Gaussian, Poisson, Gamma or Tweedie regression with identity or log link.

    Minimised is mean deviance / 2 + lambda_ * (alpha * L1 + (1 - alpha) / 2 * L2^2)
    of the coefficients of standardised predictors.
    """

    label = names.GENERALIZED_LINEAR
    tasks = ("regression",)
    layouts = ("linear",)

    family: str = param("gaussian", choices=names.GLM_FAMILIES)
    link: str = param("identity", choices=names.GLM_LINKS)
    intercept: bool = True
    lambda_: float = param(0.0, 0, 10)
    alpha: float = param(0.5, 0, 1)
    max_iterations: int = param(100, 1, 300)
    variance_power: float = param(1.5, 0, 10)
    tolerance: float = 1e-6
    seed: int = 123

    def _fit(self, data: TrainingData):
        if self.family == "gaussian" and self.link == "identity":
            spread = data.df.agg(F.stddev_pop(LABEL)).first()[0] if self.lambda_ > 0 else 1.0
            strength, share = self._mllib_penalty(1.0, spread)
            model = LinearRegression(
                featuresCol=data.encoder.linear,
                labelCol=LABEL,
                regParam=strength,
                elasticNetParam=share,
                fitIntercept=self.intercept,
                maxIter=self.max_iterations,
                tol=self.tolerance,
            ).fit(data.df)
            return mllib_score(model), (), model
        columns = len(data.encoder.linear_names)
        if self.lambda_ > 0:
            return self._fit_penalised(data) if columns <= GRAM_COLUMNS else self._fit_penalised_wide(data)
        if columns > MLLIB_GLM_COLUMNS:
            raise ValueError(f"{columns} columns; without a penalty at most {MLLIB_GLM_COLUMNS} are solved, set lambda_ for more")
        glr = GeneralizedLinearRegression(
            featuresCol=data.encoder.linear,
            labelCol=LABEL,
            family=self.family,
            fitIntercept=self.intercept,
            maxIter=self.max_iterations,
            tol=self.tolerance,
        )
        if self.family == "tweedie":
            glr.setVariancePower(self.variance_power).setLinkPower(0.0 if self.link == "log" else 1.0)
        else:
            glr.setLink(self.link)
        model = glr.fit(data.df)
        return mllib_score(model), (), model

    def _power(self) -> float:
        return {"gaussian": 0.0, "poisson": 1.0, "gamma": 2.0}.get(self.family, self.variance_power)

    def _mllib_penalty(self, factor: float, spread: float) -> tuple[float, float]:
        """Penalty parameters for MLlib's least squares, which weighs L2 by 1 / sd(target)."""
        lasso = factor * self.lambda_ * self.alpha
        ridge = factor * self.lambda_ * (1 - self.alpha) * spread
        total = lasso + ridge
        return total, (lasso / total if total > 0 else 0.0)

    def _fit_penalised(self, data: TrainingData):
        """Iteratively reweighted elastic net, one pass over the rows for each reweighting.

        Every task adds up its weighted Gram matrix of the standardised predictors and the working
        response; the tasks' sums meet on the executors, and coordinate descent runs on the one
        matrix of columns by columns that reaches the driver.
        """
        column = data.encoder.linear
        row = data.df.agg(
            Summarizer.metrics("mean", "std").summary(F.col(column)).alias("x"), F.avg(LABEL).alias("y"), F.count(F.lit(1)).alias("n")
        ).first()
        mean, std = row["x"]["mean"].toArray(), row["x"]["std"].toArray()
        std = np.where(std > 0, std, 1.0)
        rows = data.df.select(vector_to_array(column).alias("x"), F.col(LABEL).alias("y"))
        fit, last, passes = None, None, 1
        for _ in range(self.max_iterations):
            gram = self._weighted_gram(rows, mean, std, row["y"], fit)
            passes += 1
            fit = _coordinate_descent(gram, row["n"], self.lambda_ * self.alpha, self.lambda_ * (1 - self.alpha), self.intercept, mean / std, fit)
            if last is not None and np.max(np.abs(fit - last)) <= self.tolerance * max(1.0, np.max(np.abs(fit))):
                break
            last = fit
        coefficients = fit[:-1] / std
        intercept = float(fit[-1] - coefficients @ mean)
        weights = F.lit(coefficients.tolist())

        def score(df, name):
            terms = F.zip_with(vector_to_array(column), weights, lambda a, b: a * b)
            eta = F.aggregate(terms, F.lit(intercept), lambda a, b: a + b)
            return df.withColumn(name, F.exp(eta) if self.link == "log" else eta)

        return score, (), PenalisedModel(Vectors.dense(coefficients), intercept, fit, passes)

    def _weighted_gram(self, rows, mean, std, y_mean, fit) -> np.ndarray:
        """Sums of w, w x, w z, w x x', w x z over the rows, as one matrix over (x, z, 1)."""
        floor, log = 1e-8 + abs(y_mean) * 1e-6, self.link == "log"
        gaussian, power = self.family == "gaussian", self._power()

        def sums(batches):
            size = len(mean) + 2
            total, seen = np.zeros((size, size)), False
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = (batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1) - mean) / std
                y = batch.column("y").to_numpy()
                if fit is None:
                    # Start from the data, as is usual for reweighted least squares.
                    mu = y if gaussian else (y + y_mean) / 2
                    mu = mu if gaussian and not log else np.maximum(mu, floor)
                    eta = np.log(mu) if log else mu
                else:
                    eta = x @ fit[:-1] + fit[-1]
                    mu = np.exp(eta) if log else eta
                    mu = mu if gaussian else np.maximum(mu, floor)
                slope = mu if log else np.ones_like(mu)
                weight = slope * slope / mu**power
                design = np.column_stack([x, eta + (y - mu) / slope, np.ones(len(y))])
                total += (design * weight[:, None]).T @ design
                seen = True
            if seen:
                part = TaskContext.get().partitionId()
                own = pa.array([total.ravel()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "own": own})

        merged = sum_vectors(rows.mapInArrow(sums, "part int, own array<double>"), "part", "own")
        if merged is None:
            raise ValueError("there is no complete training row")
        return merged.reshape(len(mean) + 2, -1)

    def _fit_penalised_wide(self, data: TrainingData):
        """The same for more columns than a matrix of columns by columns should have.

        Each round is one weighted least-squares fit of MLlib on the working
        response, that is one pass that adds up a features-by-features matrix. MLlib
        divides by the sum of weights, so the penalty is rescaled by rows / that sum.
        """
        scaler = StandardScaler(inputCol=data.encoder.linear, outputCol=_SCALED, withMean=False, withStd=True).fit(data.df)
        rows = scaler.transform(data.df).select(LABEL, _SCALED)
        n, mean = rows.agg(F.count(F.lit(1)), F.avg(LABEL)).first()
        y = F.col(LABEL)
        # Start from the data, as is usual for reweighted least squares.
        floor = 1e-8 + abs(mean) * 1e-6
        mu = (y + F.lit(mean)) / 2 if self.family != "gaussian" else y
        mu = F.greatest(mu, F.lit(floor)) if self.link == "log" or self.family != "gaussian" else mu
        model, last = None, None
        # Only keeps the sum of squares below from cancelling.
        centre = float(np.log(max(mean, floor))) if self.link == "log" else mean
        for _ in range(self.max_iterations):
            if model is None:
                eta = F.log(mu) if self.link == "log" else mu
                work = rows
            else:
                work = model.transform(rows)
                eta = F.col("__eta")
                mu = F.exp(eta) if self.link == "log" else eta
                if self.family != "gaussian":
                    mu = F.greatest(mu, F.lit(floor))
            slope = mu if self.link == "log" else F.lit(1.0)
            weight = slope * slope / F.pow(mu, F.lit(self._power()))
            work = work.select(
                _SCALED, (eta + (y - mu) / slope).alias("__z"), weight.cast("double").alias("__w")
            )
            z = F.col("__z") - F.lit(centre)
            total, first, second = work.agg(F.sum("__w"), F.sum(z * F.col("__w")), F.sum(z * z * F.col("__w"))).first()
            spread = float(np.sqrt(max(second / total - (first / total) ** 2, 0.0)))
            strength, share = self._mllib_penalty(n / total, spread)
            model = LinearRegression(
                featuresCol=_SCALED,
                labelCol="__z",
                weightCol="__w",
                predictionCol="__eta",
                regParam=strength,
                elasticNetParam=share,
                fitIntercept=self.intercept,
                standardization=False,
                maxIter=200,
                tol=1e-9,
            ).fit(work)
            now = np.append(model.coefficients.toArray(), model.intercept)
            if last is not None and np.max(np.abs(now - last)) <= self.tolerance * max(1.0, np.max(np.abs(now))):
                break
            last = now

        def score(df, name):
            out = model.transform(scaler.transform(df)).drop(_SCALED)
            value = F.exp("__eta") if self.link == "log" else F.col("__eta")
            return out.withColumn(name, value).drop("__eta")

        return score, (), model


@dataclass(frozen=True)
class Logistic(Learner):
    """Binomial or multinomial logistic regression with elastic net."""

    label = names.LOGISTIC
    tasks = ("classification",)
    layouts = ("linear",)

    elastic_net: float = param(0.0, 0, 1)
    intercept: bool = True
    reg_param: float = param(0.0, 0, 10)
    max_iterations: int = param(20, 1, 300)

    def rows_apart(self) -> int:
        # A penalty is on standardised columns, whose deviations MLlib corrects by weights, not rows.
        return 1 if self.reg_param == 0 else 0

    def _fit(self, data: TrainingData):
        model = LogisticRegression(
            featuresCol=data.encoder.linear,
            labelCol=LABEL,
            family="auto",
            elasticNetParam=self.elastic_net,
            fitIntercept=self.intercept,
            regParam=self.reg_param,
            maxIter=self.max_iterations,
            **({"weightCol": WEIGHT} if data.folded else {}),
        ).fit(data.df)
        return mllib_score(model), (), model


def standardised_coefficients(data: TrainingData, model) -> list[tuple[str, float]]:
    """|coefficient| * standard deviation per predictor, summed over classes and levels."""
    sd = data.df.agg(Summarizer.std(F.col(data.encoder.linear)).alias("sd")).first()["sd"].toArray()
    if hasattr(model, "coefficientMatrix"):
        size = np.abs(model.coefficientMatrix.toArray()).sum(axis=0)
    else:
        size = np.abs(model.coefficients.toArray())
    totals: dict[str, float] = {}
    for name, value in zip(data.encoder.linear_names, size * sd):
        totals[name] = totals.get(name, 0.0) + float(value)
    return list(totals.items())
