"""The network's optimiser over many tasks against the same steps in one process."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from modelloom import learners as L
from modelloom.learners.base import encode_training
from modelloom.learners.neural import Network, State, even_blocks
from modelloom.operators.encode import LABEL


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (12_800, 2))
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.3, len(x))
    rows = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double")


def trained(df, partitions, **params):
    data = encode_training(df, "y", "regression", ["a", "b"], ["id"], partitions=partitions)
    learner = L.NeuralNetwork(hidden=(16, 16), epochs=10, **params)
    try:
        return learner, data, learner.fit(data)
    finally:
        data.release()


def plain(learner, data, epochs):
    """All partitions' steps one after another, their states averaged by rows after each epoch; rows come in Arrow batches of 10,000."""
    rows = data.df.select(F.spark_partition_id().alias("p"), vector_to_array(data.encoder.linear).alias("x"), F.col(LABEL).alias("y")).collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    parts = {p: np.array([i for i, r in enumerate(rows) if r.p == p]) for p in sorted({r.p for r in rows})}
    x = ((x - x.mean(axis=0)) / x.std(axis=0, ddof=1)).astype(np.float32)
    y = ((y - y.mean()) / y.std(ddof=1)).astype(np.float32)
    net = Network([2, 16, 16, 1], learner.activation)
    state, history = State.of(net.initial(learner.seed)), []
    for epoch in range(epochs):
        states, sizes, losses = [], [], 0.0
        for p, at in parts.items():
            own, seen, lost = learner.steps(net, state, [(x[i], y[i]) for i in np.split(at, range(10_000, len(at), 10_000))], np.random.default_rng([learner.seed, epoch, p]), "Quadratic")
            states.append(own.pack())
            sizes.append(seen)
            losses += lost
        state = State.unpack(np.average(states, axis=0, weights=sizes))
        history.append(losses / sum(sizes))
    return state.weights, history


@pytest.mark.parametrize("partitions", [1, 3])
def test_equals_one_process(curve, partitions):
    learner, data, model = trained(curve, partitions)
    weights, history = plain(learner, data, 10)
    assert model.model["history"] == pytest.approx(history, rel=1e-3)
    assert np.abs(model.model["weights"] - weights).max() < 0.02


def test_loss_does_not_hang_on_the_number_of_tasks(curve):
    """Sixty-four tasks of two hundred rows reach the loss of one task with all of them."""
    losses = [trained(curve, n)[2].model["history"][-1] for n in (1, 64)]
    assert losses[1] == pytest.approx(losses[0], rel=0.05)


def test_state_goes_on_from_epoch_to_epoch(curve):
    state = State(np.arange(3.0), np.ones(3), np.full(3, 2.0), 7.0)
    again = State.unpack(state.pack())
    assert (again.weights == state.weights).all() and (again.second == state.second).all() and again.steps == 7
    # One row more: the moments decay from their old values instead of starting at zero.
    learner = L.NeuralNetwork(hidden=(1,), rate=1e-3)
    net = Network([1, 1, 1], "Tanh")
    before = State(np.full(4, 0.5), np.full(4, 0.25), np.full(4, 0.125), 100.0)
    after, seen, _ = learner.steps(net, before, [(np.zeros((1, 1), np.float32), np.zeros(1, np.float32))], np.random.default_rng(0), "Quadratic")
    assert seen == 1 and after.steps == 101
    assert after.first[0] == pytest.approx(0.225) and after.second[0] == pytest.approx(0.125 * 0.999)


def test_blocks_are_even_whatever_the_batches():
    x, y = np.arange(50.0).reshape(25, 2), np.arange(25.0)
    for cuts in ([], [1, 2, 3], [7, 14, 21], [24]):
        found = list(even_blocks(zip(np.split(x, cuts), np.split(y, cuts)), 10))
        assert [len(b) for _, b in found] == [10, 10, 5]
        assert (np.concatenate([a for a, _ in found]) == x).all() and (np.concatenate([b for _, b in found]) == y).all()
    assert list(even_blocks([], 10)) == []


def test_model_does_not_hang_on_arrow_batches(spark, curve):
    """Text operators make the session's batches smaller; the network shuffles the same rows together."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, weights = spark.conf.get(name), []
    try:
        for rows in (10_000, 700):
            spark.conf.set(name, rows)
            weights.append(trained(curve, 1)[2].model["weights"])
    finally:
        spark.conf.set(name, before)
    assert weights[0] == pytest.approx(weights[1], abs=1e-6)


def test_many_steps_do_not_stop_the_learning():
    """Ten classes at random: what can be learnt is the rows by heart, and the loss falls below that of guessing."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(20_000, 64)).astype(np.float32), rng.integers(0, 10, 20_000).astype(np.float32)
    learner = L.NeuralNetwork()
    net = Network([64, *learner.hidden, 10], learner.activation)
    state, history = State.of(net.initial(learner.seed)), []
    for epoch in range(learner.epochs):
        state, seen, lost = learner.steps(net, state, [(x[:10_000], y[:10_000]), (x[10_000:], y[10_000:])], np.random.default_rng(epoch), "CrossEntropy")
        history.append(lost / seen)
    assert history[-1] < np.log(10) - 0.2
    out, _ = net.forward(net.unpack(state.weights.astype(np.float32)), x)
    assert (out.argmax(axis=1) != y).mean() < 0.8
