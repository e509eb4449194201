from modelloom.learners.base import Fitted, Learner, predict_all, train_model
from modelloom.learners.bayes import MLlibNaiveBayes, NaiveBayes
from modelloom.learners.linear import GeneralizedLinear, Logistic
from modelloom.learners.neural import NeuralNetwork
from modelloom.learners.trees import DecisionTree, GradientBoosting, RandomForest

REGRESSION = (GeneralizedLinear, RandomForest, NeuralNetwork, GradientBoosting, DecisionTree)
CLASSIFICATION = (NaiveBayes, MLlibNaiveBayes, Logistic, RandomForest, NeuralNetwork, GradientBoosting, DecisionTree)

REGISTRY = {c.__name__: c for c in dict.fromkeys(REGRESSION + CLASSIFICATION)}


def learner(name: str, **params) -> Learner:
    """A learner by its class name or label, e.g. 'RandomForest' or 'Random forest'."""
    by_label = {c.label: c for c in reversed(REGISTRY.values())}
    kind = REGISTRY.get(name) or by_label.get(name)
    if kind is None:
        raise ValueError(f"no learner {name!r}; there are {sorted(REGISTRY)}")
    return kind(**params)


__all__ = [
    "CLASSIFICATION",
    "DecisionTree",
    "Fitted",
    "GeneralizedLinear",
    "GradientBoosting",
    "Learner",
    "Logistic",
    "MLlibNaiveBayes",
    "NaiveBayes",
    "NeuralNetwork",
    "REGISTRY",
    "REGRESSION",
    "RandomForest",
    "learner",
    "predict_all",
    "train_model",
]
