"""Decision tree, random forest and gradient boosting."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext, StorageLevel, inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from modelloom.learners import names
from modelloom.learners.base import WEIGHT, Learner, TrainingData, mllib_score, param
from modelloom.operators.encode import LABEL, TREE
from modelloom.session import ensure_checkpoint_dir

# Spark trains the nodes of a tree level in groups that fit this many megabytes;
# more memory means fewer passes over the data.
NODE_MEMORY_MB = 512
RESPONSE_BOUND = 4.0
LEAST_WEIGHT = 1e-6
CHECKPOINT_EVERY = 10  # rounds of joint boosting
#: Numbers with up to so many different values are split between any two of them.
FEW_VALUES = 256


def _bins(data: TrainingData, wanted: int) -> int:
    """MLlib needs at least as many bins, for all columns, as the widest category has levels."""
    if data.encoder.max_levels > wanted:
        warnings.warn(
            f"bins raised from {wanted} to {data.encoder.max_levels}, the levels of the widest category; "
            "group its levels (see max_levels) to keep fewer",
            stacklevel=2,
        )
    return max(wanted, data.encoder.max_levels, 2)


def _bins_of_few_values(data: TrainingData, wanted: int) -> int:
    """Bins for forests and boosting: one for each value of a number with few of them, and ``wanted`` at least.

    MLlib lays the bins once, by quantiles of a sample; fewer bins than values leave out the same
    splits in every tree. The reference's learners lay them anew at each node, so depth finds every split.
    """
    numbers = data.encoder.n_tree_numbers
    if not numbers:
        return wanted
    cells = data.df.select(F.posexplode(F.slice(vector_to_array(TREE), 1, numbers)).alias("i", "v"))
    about = cells.groupBy("i").agg(F.approx_count_distinct("v").alias("n")).where(F.col("n").between(wanted * 0.7, FEW_VALUES * 1.3)).collect()
    if not about:
        return wanted
    counts = cells.where(F.col("i").isin([r["i"] for r in about])).distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return max([wanted, *(r["n"] for r in counts.collect() if r["n"] <= FEW_VALUES)])


def _importance(data: TrainingData, vector) -> list[tuple[str, float]]:
    values = vector if isinstance(vector, np.ndarray) else vector.toArray()
    return [(n, float(v)) for n, v in zip(data.encoder.tree_names, values)]


def _common(data: TrainingData, depth: int, bins: int, seed: int) -> dict:
    # Checkpoints let node ids and boosting rounds drop their lineage.
    ensure_checkpoint_dir(data.df.sparkSession)
    return {
        "featuresCol": TREE,
        "labelCol": LABEL,
        "maxDepth": depth,
        "maxBins": _bins(data, bins),
        "maxMemoryInMB": NODE_MEMORY_MB,
        "seed": seed,
    } | ({"weightCol": WEIGHT} if data.folded else {})


@dataclass(frozen=True)
class DecisionTree(Learner):
    label = names.DECISION_TREE
    tasks = ("regression", "classification")
    layouts = ("tree",)

    max_depth: int = param(20, 1, 30)
    bins: int = param(32, 2, 10_000)
    min_rows: int = param(1, 1, 1_000_000)
    seed: int = 123

    def rows_apart(self) -> int:
        # MLlib counts rows, not weights, for the least leaf and to limit the bins.
        return max(self.min_rows, self.bins)

    def _fit(self, data: TrainingData):
        kind = DecisionTreeRegressor if data.task == "regression" else DecisionTreeClassifier
        model = kind(
            minInstancesPerNode=self.min_rows, **_common(data, self.max_depth, self.bins, self.seed)
        ).fit(data.df)
        return mllib_score(model), _importance(data, model.featureImportances), model


@dataclass(frozen=True)
class RandomForest(Learner):
    label = names.RANDOM_FOREST
    tasks = ("regression", "classification")
    layouts = ("tree",)

    trees: int = param(50, 1, 100)
    sample_rate: float = param(0.6, 0.1, 1)
    max_depth: int = param(20, 1, 30)
    bins: int = param(20, 2, 10_000)
    bootstrap: bool = True
    seed: int = 123

    def rows_apart(self) -> int:
        return self.bins if self.sample_rate == 1 and not self.bootstrap else 0

    def _fit(self, data: TrainingData):
        kind = RandomForestRegressor if data.task == "regression" else RandomForestClassifier
        # Deep forests carry many nodes; cached node ids spare sending the trees
        # to every task on each level.
        model = kind(
            numTrees=self.trees,
            subsamplingRate=self.sample_rate,
            bootstrap=self.bootstrap,
            cacheNodeIds=self.max_depth > 10,
            **_common(data, self.max_depth, _bins_of_few_values(data, self.bins), self.seed),
        ).fit(data.df)
        return mllib_score(model), _importance(data, model.featureImportances), model


@dataclass(frozen=True)
class GradientBoosting(Learner):
    """Boosted trees; more than two classes are boosted jointly over a softmax."""

    label = names.GRADIENT_BOOSTING
    tasks = ("regression", "classification")
    layouts = ("tree",)

    trees: int = param(50, 1, 100)
    max_depth: int = param(5, 1, 30)
    sample_rate: float = param(1.0, 0.1, 1)
    learn_rate: float = param(0.1, 1e-6, 1)
    min_rows: int = param(2, 1, 1_000_000)
    bins: int = param(32, 2, 10_000)
    parallelism: int = 4
    seed: int = 123

    def rows_apart(self) -> int:
        return max(self.min_rows, self.bins) if self.sample_rate == 1 else 0

    def _fit(self, data: TrainingData):
        shared = {
            "maxIter": self.trees,
            "stepSize": self.learn_rate,
            "subsamplingRate": self.sample_rate,
            "minInstancesPerNode": self.min_rows,
            **_common(data, self.max_depth, _bins_of_few_values(data, self.bins), self.seed),
        }
        if data.task == "regression":
            model = GBTRegressor(**shared).fit(data.df)
            return mllib_score(model), _importance(data, model.featureImportances), model
        if len(data.classes) == 2:
            model = GBTClassifier(**shared).fit(data.df)
            return mllib_score(model), _importance(data, model.featureImportances), model
        return self._multinomial(data, shared["maxBins"])

    def _multinomial(self, data: TrainingData, bins: int):
        """One regression tree per class and round, on the slope of the softmax likelihood.

        Trees are fitted to (y - p) / w with weights w = p (1 - p), so that a leaf's
        weighted mean is its Newton step (Friedman, Hastie and Tibshirani 2000, whose
        bound on the working response is used too). The rows carry their scores, to
        which each round adds its own trees only; every tenth round is checkpointed,
        so that no long lineage builds up.
        """
        count = len(data.classes)
        rows = data.df.groupBy(LABEL).agg(F.sum(data.weight).alias("n")).collect()
        sizes = np.zeros(count)
        for r in rows:
            sizes[int(r[LABEL])] = r["n"]
        prior = [float(v) for v in np.log(sizes / sizes.sum())]
        rate = self.learn_rate * (count - 1) / count
        settings = _common(data, self.max_depth, bins, self.seed) | {"labelCol": "__z", "weightCol": "__w"}

        def grow(frame, k: int):
            p = F.col("__p")[k]
            weight = F.greatest(p * (1 - p), F.lit(LEAST_WEIGHT))
            step = (F.when(F.col(LABEL) == k, 1.0).otherwise(0.0) - p) / weight
            work = frame.select(
                TREE,
                F.least(F.greatest(step, F.lit(-RESPONSE_BOUND)), F.lit(RESPONSE_BOUND)).alias("__z"),
                (weight * F.col(WEIGHT)).alias("__w"),
            )
            return DecisionTreeRegressor(minInstancesPerNode=self.min_rows, **settings).fit(work)

        rounds: list[list] = []
        scored = data.df.select(LABEL, TREE, data.weight.alias(WEIGHT), F.array(*[F.lit(v) for v in prior]).alias("__f"))
        held = None
        for t in range(self.trees):
            top = F.array_max("__f")
            e = F.transform("__f", lambda v: F.exp(v - top))
            total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
            frame = scored.select(LABEL, TREE, WEIGHT, F.transform(e, lambda v: v / total).alias("__p"))
            if self.sample_rate < 1:
                frame = frame.sample(self.sample_rate, seed=self.seed + t)
            frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                with ThreadPoolExecutor(self.parallelism) as pool:
                    one = inheritable_thread_target(frame.sparkSession)(lambda k: grow(frame, k))
                    rounds.append(list(pool.map(one, range(count))))
            finally:
                frame.unpersist()
            if t + 1 == self.trees:
                break
            # MLlib's own scoring adds the new trees; the rows are held for the next round.
            for k, tree in enumerate(rounds[-1]):
                scored = tree.setPredictionCol(f"__t{k}").transform(scored)
            added = F.array(*[F.col("__f")[k] + F.lit(rate) * F.col(f"__t{k}") for k in range(count)])
            scored = scored.select(LABEL, TREE, WEIGHT, added.alias("__f"))
            before, held = held, (scored.checkpoint() if (t + 1) % CHECKPOINT_EVERY == 0 else scored).persist(StorageLevel.MEMORY_AND_DISK)
            held.count()
            scored = held
            if before is not None:
                before.unpersist()
        if held is not None:
            held.unpersist()
        ensembles = [weighted_trees([trees[k] for trees in rounds], rate) for k in range(count)]

        def score(df, name):
            out = df
            for k, ensemble in enumerate(ensembles):
                out = ensemble.setPredictionCol(f"__t{k}").transform(out)
            total = F.array(*[F.lit(v) + F.col(f"__t{k}") for k, v in enumerate(prior)])
            # Equal scores go to the first class.
            out = out.withColumn(name, (F.array_position(total, F.array_max(total)) - 1).cast("double"))
            return out.drop(*[f"__t{k}" for k in range(count)])

        shares = np.mean([tree.featureImportances.toArray() for trees in rounds for tree in trees], axis=0)
        return score, _importance(data, shares / (shares.sum() or 1.0)), rounds


def weighted_trees(trees: Sequence[DecisionTreeRegressionModel], rate: float) -> GBTRegressionModel:
    """MLlib's own model of the trees' sum, each times ``rate``."""
    gateway = SparkContext._active_spark_context._gateway
    kind = gateway.jvm.org.apache.spark.ml.regression
    members = gateway.new_array(kind.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(gateway.jvm.double, len(trees))
    for i, tree in enumerate(trees):
        members[i], weights[i] = tree._java_obj, rate
    model = GBTRegressionModel(kind.GBTRegressionModel(trees[0].uid, members, weights))
    return model.setFeaturesCol(TREE)
