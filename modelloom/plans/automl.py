"""A time-boxed search over learner families, itself usable as a learner."""

from __future__ import annotations

import json
import math
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import functions as F

from modelloom import learners as L
from modelloom.learners import names
from modelloom.learners.base import KEY, KEY_BITS, RAW, Learner, TrainingData, mllib_score, param
from modelloom.learners.linear import standardised_coefficients
from modelloom.operators.encode import LABEL, TREE

# First round, one candidate per family, the cheap ones first.
ORDER = ("GLM", "DRF", "GBM", "DeepLearning", "XGBoost")
FOLD = "__fold"
SEARCH_SHARE = 0.7  # of the time budget; the rest is for the refit
REPEATS = 50  # draws already tried before the search counts as exhausted


@dataclass(frozen=True)
class XGBoost(Learner):
    """The XGBoost family; needs the optional xgboost package."""

    label = "XGBoost"
    tasks = ("regression", "classification")

    trees: int = param(50, 1, 1000)
    max_depth: int = param(6, 1, 30)
    learn_rate: float = param(0.3, 1e-6, 1)
    seed: int = 123

    def _fit(self, data: TrainingData):
        from xgboost.spark import SparkXGBClassifier, SparkXGBRegressor

        kind = SparkXGBRegressor if data.task == "regression" else SparkXGBClassifier
        model = kind(
            features_col=TREE,
            label_col=LABEL,
            n_estimators=self.trees,
            max_depth=self.max_depth,
            learning_rate=self.learn_rate,
            random_state=self.seed,
        ).fit(data.df)
        found = model.get_feature_importances(importance_type="gain")
        names = data.encoder.tree_names
        return mllib_score(model), [(n, float(found.get(f"f{i}", 0.0))) for i, n in enumerate(names)], model


def _available(family: str) -> bool:
    if family != "XGBoost":
        return True
    try:
        import xgboost.spark  # noqa: F401
    except ImportError:
        return False
    return True


def _default(family: str, task: str, seed: int) -> Learner:
    if family == "GLM":
        return L.GeneralizedLinear() if task == "regression" else L.Logistic()
    kinds = {"DRF": L.RandomForest, "GBM": L.GradientBoosting, "DeepLearning": L.NeuralNetwork, "XGBoost": XGBoost}
    return kinds[family](seed=seed)


def _drawn(family: str, task: str, rng: np.random.Generator, seed: int) -> Learner:
    def pick(*values):
        return values[rng.integers(len(values))]

    if family == "GLM" and task == "regression":
        return L.GeneralizedLinear(lambda_=pick(0.001, 0.01, 0.1, 1.0), alpha=pick(0.0, 0.5, 1.0))
    if family == "GLM":
        return L.Logistic(reg_param=pick(0.001, 0.01, 0.1, 1.0), elastic_net=pick(0.0, 0.5, 1.0))
    if family == "DRF":
        return L.RandomForest(trees=pick(20, 50, 100), max_depth=pick(6, 10, 15, 20), sample_rate=pick(0.4, 0.6, 0.8), seed=seed)
    if family == "GBM":
        return L.GradientBoosting(trees=pick(20, 50, 100), max_depth=pick(3, 5, 7), learn_rate=pick(0.05, 0.1, 0.3), seed=seed)
    if family == "DeepLearning":
        return L.NeuralNetwork(hidden=pick((50,), (100, 100), (200, 200)), rate=pick(0.001, 0.005, 0.01), epochs=pick(10, 20), seed=seed)
    return XGBoost(trees=pick(50, 100, 200), max_depth=pick(3, 6, 9), learn_rate=pick(0.1, 0.3), seed=seed)


@dataclass(frozen=True)
class Candidate:
    family: str
    learner: Learner
    metric: float | None = None
    seconds: float = 0.0
    status: str = "not started"
    fitted: object = None
    rung: int = 0
    rows: int = 0


@dataclass(frozen=True)
class AutoML(Learner):
    """Tries candidates until time or their number runs out; the best is refitted.

    Candidates are scored by cross-validation on the cached training rows (root
    mean squared error, or error rate in percent); folds follow a hash of the key.
    ``max_seconds`` is a hard limit: the search has ``SEARCH_SHARE`` of it, the rest
    is the refit's, and running jobs are cancelled when either is over. If time ends
    before all folds of any candidate, those done count; if it ends before the
    refit, the leader's last fold model is used. Without one finished fold there is
    no leader and TimeoutError is raised. Results repeat exactly only with
    ``max_models`` and no time limit.

    With ``rungs`` above 1 the search halves successively: brackets of candidates start on a small
    sample of the rows, the best ``keep`` of them go on to one that is 1 / ``keep`` times as large, and so on up
    to all rows. Samples are the rows of least key hash, so each holds the ones before it. Of all
    candidates the best of those that came furthest leads.
    """

    label = names.AUTO_ML
    tasks = ("regression", "classification")

    families: tuple[str, ...] = names.SEARCH_FAMILIES
    max_seconds: float | None = 15.0
    max_models: int | None = None
    folds: int = param(3, 2, 20)
    rungs: int = param(1, 1, 8)
    keep: float = param(1 / 3, 0.05, 0.9)
    seed: int = 123
    defaults: tuple[tuple[str, Learner], ...] = ()

    def __post_init__(self):
        super().__post_init__()
        unknown = [f for f in self.families if f not in names.SEARCH_FAMILIES]
        if not self.families or unknown:
            raise ValueError(f"choose families out of {names.SEARCH_FAMILIES}; unknown: {unknown}")
        if self.max_seconds is None and self.max_models is None:
            raise ValueError("set max_seconds or max_models")

    def _fit(self, data: TrainingData):
        sc = data.df.sparkSession.sparkContext
        started = time.monotonic()
        limit = None if self.max_seconds is None else started + SEARCH_SHARE * self.max_seconds
        tried = self._search(data, sc, limit)
        done = [c for c in tried if c.metric is not None]
        if not done:
            if any(c.status in ("timed out", "not started") for c in tried):
                raise TimeoutError(f"no candidate finished a fold within {self.max_seconds} seconds")
            raise RuntimeError(f"no candidate could be trained: {[(c.family, c.status) for c in tried]}")
        best = min(done, key=lambda c: (c.status != "ok", -c.rung, c.metric))
        leader, refitted = best.fitted, False
        with time_box(sc, None if self.max_seconds is None else started + self.max_seconds) as over:
            try:
                leader, refitted = best.learner.fit(data), True
                importance = leader.importance
                if best.family == "GLM" and hasattr(leader.model, "numFeatures"):
                    importance = standardised_coefficients(data, leader.model)
            except Exception:
                if not over.is_set():
                    raise
                importance = leader.importance
        tried = [replace(c, fitted=None) for c in tried]
        return leader.score, importance, {"leader": leader, "family": best.family, "candidates": tried, "refitted": refitted}

    def _candidates(self, task: str):
        given = dict(self.defaults)
        rng = np.random.default_rng(self.seed)
        families = [f for f in ORDER if f in self.families]
        usable = [f for f in families if _available(f)]
        for f in families:
            if f not in usable:
                yield Candidate(f, _default(f, task, self.seed), status="unavailable")
        for f in usable:
            yield Candidate(f, given.get(f) or _default(f, task, self.seed))
        while usable:
            f = usable[rng.integers(len(usable))]
            yield Candidate(f, _drawn(f, task, rng, self.seed))

    def _search(self, data: TrainingData, sc, deadline) -> list[Candidate]:
        fold = F.pmod(F.xxhash64(F.lit(self.seed), KEY), F.lit(self.folds)).cast("int")
        folded = data.df.withColumn(FOLD, fold).persist()
        tried, seen, models, repeats = [], set(), 0, 0
        bracket: list[Candidate] = []
        size = 1 if self.rungs == 1 else max(2, round(self.keep ** (1 - self.rungs)))
        try:
            for candidate in self._candidates(data.task):
                if candidate.status == "unavailable":
                    tried.append(candidate)
                    continue
                late = deadline is not None and time.monotonic() >= deadline
                if late or (self.max_models is not None and models >= self.max_models):
                    missing = {f for f in self.families if f not in {c.family for c in [*tried, *bracket]}}
                    if candidate.family not in missing:
                        break
                    tried.append(candidate)
                    continue
                if candidate.learner in seen:
                    repeats += 1
                    if repeats >= REPEATS:
                        break
                    continue
                seen.add(candidate.learner)
                bracket.append(candidate)
                models += 1
                if len(bracket) == size:
                    tried += self._halve(bracket, folded, data, sc, deadline)
                    bracket = []
            tried += self._halve(bracket, folded, data, sc, deadline)
        finally:
            folded.unpersist()
        return tried

    def _halve(self, bracket: list[Candidate], folded, data: TrainingData, sc, deadline) -> list[Candidate]:
        """The candidates of a bracket, each as judged on the largest sample that it came to."""
        latest, alive = list(bracket), list(range(len(bracket)))
        for rung in range(1, self.rungs + 1):
            share = self.keep ** (self.rungs - rung)
            sample = folded if rung == self.rungs else folded.filter(F.col(KEY) < F.lit(int(share * 2**KEY_BITS)))
            for i in list(alive):
                if rung > 1 and deadline is not None and time.monotonic() >= deadline:
                    return latest
                judged = replace(self._judge(latest[i], sample, data, sc, deadline), rung=rung)
                # What ran out of time or failed on more rows keeps what it reached on fewer.
                if judged.metric is not None and (judged.status == "ok" or rung == 1):
                    latest[i] = replace(judged, seconds=judged.seconds + latest[i].seconds)
                else:
                    latest[i] = judged if rung == 1 else replace(latest[i], status=judged.status)
                    alive.remove(i)
            alive = sorted((i for i in alive if latest[i].status == "ok"), key=lambda i: latest[i].metric)
            alive = alive[: max(1, math.ceil(len(alive) * self.keep))]
        return latest

    def _judge(self, candidate: Candidate, folded, data: TrainingData, sc, deadline) -> Candidate:
        started = time.perf_counter()
        total, rows, fitted, status = 0.0, 0, None, "ok"
        with time_box(sc, deadline) as over:
            try:
                for k in range(self.folds):
                    if over.is_set():
                        raise TimeoutError
                    part = TrainingData(folded.filter(F.col(FOLD) != k).drop(FOLD), data.encoder, data.task, data.classes)
                    model = candidate.learner.fit(part)
                    scored = model.score(folded.filter(F.col(FOLD) == k), RAW)
                    if data.task == "regression":
                        loss = F.pow(F.col(RAW) - F.col(LABEL), 2)
                    else:
                        loss = F.when(F.col(RAW) != F.col(LABEL), 1.0).otherwise(0.0)
                    row = scored.agg(F.sum(loss).alias("loss"), F.count(F.lit(1)).alias("n")).first()
                    total, rows, fitted = total + (row["loss"] or 0.0), rows + row["n"], model
            except Exception as error:
                status = "timed out" if over.is_set() else f"failed: {type(error).__name__}"
        metric = None
        if rows and status in ("ok", "timed out"):
            metric = float(np.sqrt(total / rows)) if data.task == "regression" else 100.0 * total / rows
            if not np.isfinite(metric):
                metric, status = None, "failed: the metric is not a number"
        return Candidate(candidate.family, candidate.learner, metric, time.perf_counter() - started, status, fitted, rows=rows)


@contextmanager
def time_box(sc, deadline):
    """Cancels the jobs started within when the deadline is over; yields the event that says so."""
    over, tag, timer = threading.Event(), f"search-{uuid.uuid4().hex}", None

    def cancel():
        over.set()
        sc.cancelJobsWithTag(tag)

    sc.addJobTag(tag)
    if deadline is not None:
        timer = threading.Timer(max(0.0, deadline - time.monotonic()), cancel)
        timer.start()
    try:
        yield over
    finally:
        if timer is not None:
            timer.cancel()
        sc.removeJobTag(tag)


def search_leaderboard(spark, model: dict):
    """(rank, family, params, metric, seconds, status, rung, n_rows) of a finished search, best first.

    ``n_rows`` are those of the largest sample that the candidate was judged on, ``rung`` says which it was.
    """
    tried = model["candidates"]
    order = sorted(tried, key=lambda c: (c.metric is None, -c.rung, c.metric or 0.0, c.family))
    rows = [
        (
            i + 1 if c.metric is not None else None,
            c.family,
            json.dumps(asdict(c.learner), sort_keys=True),
            c.metric,
            round(c.seconds, 3),
            c.status,
            c.rung,
            c.rows,
        )
        for i, c in enumerate(order)
    ]
    return spark.createDataFrame(rows, "rank int, family string, params string, metric double, seconds double, status string, rung int, n_rows long")


def leader_summary(spark, model: dict):
    """(parameter, value) of the leader, its family first."""
    rows = [("family", model["family"])]
    rows += [(k, str(v)) for k, v in asdict(model["leader"].learner).items()]
    return spark.createDataFrame(rows, "parameter string, value string")
