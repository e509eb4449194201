"""Feed-forward network trained data-parallel.

Each epoch is one Spark job: every partition starts from the shared state, runs
mini-batch steps over its own rows batch by batch, and returns its state times
its rows; the executors add these up. The state is the weights, both moments of the optimiser and the number of
its steps, so an epoch goes on where the last one stopped, whatever the number of partitions. The
driver sees one state per epoch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.functions.vectors import sum_vectors
from modelloom.learners import names
from modelloom.learners.base import KEY, Learner, TrainingData, param
from modelloom.operators.encode import LABEL


#: Steps that a partition makes in an epoch at least, where the rows suffice.
STEPS_EACH = 100
#: Rows that are shuffled together, whatever the session's Arrow batches hold.
BLOCK_ROWS = 10_000
#: Steps after which the rate begins to fall by the root of their number. At a constant rate
#: tens of thousands of steps drive all units to zero and the network names one class.
CONSTANT_STEPS = 100


@dataclass(frozen=True)
class State:
    """Weights, Adam's moments and its number of steps; averages of states are states."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0

    @classmethod
    def of(cls, weights: np.ndarray) -> "State":
        return cls(weights, np.zeros_like(weights), np.zeros_like(weights))

    @classmethod
    def unpack(cls, flat: np.ndarray) -> "State":
        return cls(*np.split(flat[:-1], 3), float(flat[-1]))

    def pack(self) -> np.ndarray:
        return np.concatenate([self.weights, self.first, self.second, [self.steps]])


class Network:
    """Layer sizes, and forward and backward passes over a batch."""

    def __init__(self, sizes: Sequence[int], activation: str):
        self.sizes = tuple(sizes)
        self.kind = activation.replace("WithDropout", "")
        self.dropout = 0.5 if activation.endswith("WithDropout") else 0.0
        self.pieces = 2 if self.kind == "Maxout" else 1
        self.shapes = []
        for i, (a, b) in enumerate(zip(self.sizes, self.sizes[1:])):
            last = i == len(self.sizes) - 2
            self.shapes += [(a, b if last else b * self.pieces), (b if last else b * self.pieces,)]

    def initial(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = []
        for shape in self.shapes:
            if len(shape) == 1:
                parts.append(np.zeros(shape))
            else:
                limit = np.sqrt(6.0 / (shape[0] + shape[1]))
                parts.append(rng.uniform(-limit, limit, shape).ravel())
        return np.concatenate(parts)

    def unpack(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes:
            size = int(np.prod(shape))
            out.append(flat[at : at + size].reshape(shape))
            at += size
        return out

    def forward(self, weights, x, rng=None):
        """Output and what the backward pass needs; dropout only with ``rng``."""
        h, trace = x, []
        layers = len(weights) // 2
        for i in range(layers):
            z = h @ weights[2 * i] + weights[2 * i + 1]
            if i == layers - 1:
                trace.append((h, None, None))
                return z, trace
            if self.kind == "Rectifier":
                out, slope = np.maximum(z, 0.0), (z > 0).astype(z.dtype)
            elif self.kind == "Tanh":
                out = np.tanh(z)
                slope = 1.0 - out * out
            else:
                pieces = z.reshape(len(z), -1, self.pieces)
                out = pieces.max(axis=2)
                slope = (pieces == out[:, :, None]).astype(z.dtype)
                slope = (slope / slope.sum(axis=2, keepdims=True)).reshape(z.shape)
            mask = None
            if rng is not None and self.dropout:
                mask = (rng.random(out.shape) >= self.dropout) / (1.0 - self.dropout)
                out = out * mask
            trace.append((h, slope, mask))
            h = out

    def backward(self, weights, trace, delta):
        grads = [None] * len(weights)
        for i in range(len(trace) - 1, -1, -1):
            h, slope, mask = trace[i]
            if slope is not None:
                if mask is not None:
                    delta = delta * mask
                if self.pieces > 1:
                    delta = np.repeat(delta, self.pieces, axis=1)
                delta = delta * slope
            grads[2 * i] = h.T @ delta
            grads[2 * i + 1] = delta.sum(axis=0)
            if i:
                delta = delta @ weights[2 * i].T
        return grads


def output_slope(out: np.ndarray, y: np.ndarray, loss: str, quantile: float) -> tuple[float, np.ndarray]:
    """Mean loss over the batch and its slope in the network's output."""
    n = len(y)
    if loss == "CrossEntropy":
        p = np.exp(out - out.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        k = y.astype(int)
        value = -np.log(np.maximum(p[np.arange(n), k], 1e-12)).mean()
        p[np.arange(n), k] -= 1.0
        return value, p / n
    e = out - y[:, None]
    if loss == "Quadratic":
        return 0.5 * (e * e).mean(), e / n
    if loss == "Huber":
        near = np.abs(e) <= 1.0
        return np.where(near, 0.5 * e * e, np.abs(e) - 0.5).mean(), np.clip(e, -1.0, 1.0) / n
    if loss == "Absolute":
        return np.abs(e).mean(), np.sign(e) / n
    return np.maximum(-quantile * e, (1 - quantile) * e).mean(), np.where(e < 0, -quantile, 1 - quantile) / n


def _batch_matrices(batch, centre, scale, y_centre, y_scale):
    x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
    y = (batch.column("y").to_numpy() - y_centre) / y_scale
    return ((x - centre) / scale).astype(np.float32), y.astype(np.float32)


def even_blocks(matrices, rows: int = BLOCK_ROWS):
    """The (x, y) matrices anew, each of ``rows`` rows but the last."""
    held, n = [], 0
    for x, y in matrices:
        while len(x):
            held.append((x[: rows - n], y[: rows - n]))
            x, y, n = x[rows - n :], y[rows - n :], n + len(held[-1][0])
            if n == rows:
                yield tuple(np.concatenate(a) for a in zip(*held))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(a) for a in zip(*held))


@dataclass(frozen=True)
class NeuralNetwork(Learner):
    label = names.NEURAL_NETWORK
    tasks = ("regression", "classification")
    layouts = ("linear",)

    activation: str = param("Rectifier", choices=names.ACTIVATIONS)
    loss: str = param("Automatic", choices=names.LOSSES)
    hidden: tuple[int, ...] = (200, 200)
    epochs: int = param(10, 1, 100)
    rate: float = param(0.005, 1e-6, 0.1)
    batch: int = param(32, 1, 100_000)
    quantile: float = param(0.5, 0, 1)
    seed: int = 123

    def __post_init__(self):
        super().__post_init__()
        if not self.hidden or any(not isinstance(h, int) or h < 1 for h in self.hidden):
            raise ValueError(f"hidden must hold positive layer sizes, not {self.hidden!r}")

    def _fit(self, data: TrainingData):
        df = data.df
        classify = data.task == "classification"
        if classify and self.loss != "Automatic":
            raise ValueError(f"classification is trained on cross entropy; loss {self.loss!r} serves regression only")
        loss = "CrossEntropy" if classify else ("Quadratic" if self.loss == "Automatic" else self.loss)
        row = df.withColumn("__part", F.spark_partition_id()).agg(
            Summarizer.metrics("mean", "std").summary(F.col(data.encoder.linear)).alias("x"),
            F.avg(LABEL).alias("y"),
            F.stddev_samp(LABEL).alias("s"),
            F.count(LABEL).alias("n"),
            (F.max("__part") + 1).alias("parts"),
        ).first()
        centre, scale = row["x"]["mean"].toArray(), row["x"]["std"].toArray()
        scale = np.where(scale > 0, scale, 1.0)
        y_centre, y_scale = (0.0, 1.0) if classify else (row["y"], row["s"] or 1.0)
        outputs = len(data.classes) if classify else 1
        net = Network([len(centre), *self.hidden, outputs], self.activation)
        state = State.of(net.initial(self.seed))
        rows = df.select(vector_to_array(data.encoder.linear).alias("x"), F.col(LABEL).alias("y"), KEY)
        # Averages of many short walks lag behind one long one, so small partitions are put together.
        wanted = max(1, row["n"] // (self.batch * STEPS_EACH))
        few = wanted < (row["parts"] or 1)
        if few:
            rows = rows.repartition(wanted, KEY).sortWithinPartitions(KEY, "y").persist()
        history = []
        for epoch in range(self.epochs):
            state, value = self._epoch(rows.select("x", "y"), net, state, epoch, loss, centre, scale, y_centre, y_scale)
            history.append(value)
        if few:
            rows.unpersist()
        weights = state.weights
        if not np.isfinite(weights).all():
            raise RuntimeError("training diverged; lower the rate")

        def score(out: DataFrame, name: str) -> DataFrame:
            shared = out.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

            @F.pandas_udf("double")
            def predict(column: pd.Series) -> pd.Series:
                x = (np.stack(column.to_numpy()) - centre) / scale
                z, _ = net.forward(net.unpack(shared.value), x.astype(np.float32))
                best = z.argmax(axis=1) if classify else z[:, 0] * y_scale + y_centre
                return pd.Series(best.astype(float))

            return out.withColumn(name, predict(vector_to_array(data.encoder.linear)))

        return score, self._importance(data, net, weights), {"weights": weights, "history": history}

    def _epoch(self, rows, net, state, epoch, loss, centre, scale, y_centre, y_scale):
        shared = rows.sparkSession.sparkContext.broadcast(state)
        learner = self

        def local(batches):
            part = TaskContext.get().partitionId()
            rng = np.random.default_rng([learner.seed, epoch, part])
            matrices = (_batch_matrices(b, centre, scale, y_centre, y_scale) for b in batches if b.num_rows)
            own, seen, lost = learner.steps(net, shared.value, even_blocks(matrices), rng, loss)
            if seen:
                sums = np.append(own.pack() * seen, [seen, lost])
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part], pa.int32()), "own": pa.array([sums], pa.list_(pa.float64()))}
                )

        merged = sum_vectors(rows.mapInArrow(local, "part int, own array<double>"), "part", "own")
        shared.unpersist()
        if merged is None:
            raise ValueError("there is no complete training row")
        return State.unpack(merged[:-2] / merged[-2]), merged[-1] / merged[-2]

    def steps(self, net: Network, state: State, batches, rng, loss: str) -> tuple[State, int, float]:
        """Adam over mini-batches of the given (x, y) matrices, from ``state`` on: the new state, the rows and their summed loss.

        The rate falls by the root of the steps made, over all epochs.
        """
        flat, m, v = (a.astype(np.float32) for a in (state.weights, state.first, state.second))
        w, step, seen, lost = net.unpack(flat), state.steps, 0, 0.0
        for x, y in batches:
            order = rng.permutation(len(x))
            for at in range(0, len(x), self.batch):
                pick = order[at : at + self.batch]
                out, trace = net.forward(w, x[pick], rng)
                value, delta = output_slope(out, y[pick], loss, self.quantile)
                g = np.concatenate([a.ravel() for a in net.backward(w, trace, delta)])
                step += 1
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                rate = self.rate / np.sqrt(1 + step / CONSTANT_STEPS)
                flat -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                lost += float(value) * len(pick)
            seen += len(x)
        return State(flat.astype(float), m.astype(float), v.astype(float), step), seen, lost

    def _importance(self, data: TrainingData, net: Network, weights: np.ndarray):
        """Share of each input in the absolute weights of the first two layers."""
        w = net.unpack(weights)
        first = np.abs(w[0]).reshape(net.sizes[0], -1, net.pieces).sum(axis=2)
        second = np.abs(w[2]).reshape(net.sizes[1], -1)
        first = first / np.maximum(first.sum(axis=0, keepdims=True), 1e-12)
        second = second / np.maximum(second.sum(axis=0, keepdims=True), 1e-12)
        share = (first @ second).sum(axis=1)
        totals: dict[str, float] = {}
        for name, value in zip(data.encoder.linear_names, share / share.sum()):
            totals[name] = totals.get(name, 0.0) + float(value)
        return list(totals.items())
