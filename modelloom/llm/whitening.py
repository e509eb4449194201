"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed. One distributed pass multiplies it with a block of vectors:
every row is centred exactly, projected on the block and weighed by that, and the tasks' sums
are merged on the executors. The driver holds a few vectors of the embeddings' length. Each
outer step takes the Ritz vectors of the subspace, locks those whose residuals have reached
double precision, and extends the subspace by the solutions of the projected correction
equations of the others, which MINRES solves for the whole block in lockstep, so that
a step of all of them is one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelloom.functions import col
from modelloom.functions.vectors import sum_vectors
from modelloom.llm.common import list_parts

#: Fixed-point form of an entry: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries up to which they, and differences to the mean, are exact in 64 bits.
LARGEST = 1 << 52
#: Least entries of a partition of the cached vectors.
ENTRIES_EACH = 500_000
#: MINRES steps of a correction, Ritz vectors beside the wanted ones, outer steps at most.
INNER, GUARDS, OUTER = 6, 2, 200
EPS = np.finfo(np.float64).eps
LONG_MAX = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """``vectors`` (one column per component), their variances, and what centring needs."""

    n: int
    sums: np.ndarray
    trace: float
    vectors: np.ndarray
    variances: np.ndarray


def fixed_point(batch: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of long entries from a column of float lists."""
    values = np.floor(list_parts(batch)[0].astype(np.float64) * SCALE)
    if np.abs(values).max(initial=0) > LARGEST - SHIFT:
        raise ValueError("an entry is too large for exact sums")
    return (values.astype(np.int64) + SHIFT).reshape(-1, dimensions)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n in double precision; the difference n*x - S is exact where 64 bits hold it."""
    if n * (float(np.abs(x).max(initial=0)) + 1) < LONG_MAX / 2:
        return (n * x - sums.astype(np.int64)) / n
    return x - (sums / n).astype(np.float64)


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of the rows whose vector is not null or empty and holds finite numbers only."""
    vector = col(vector_col).cast("array<double>")
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    # The file's own type stays in the cache; casts to double are exact.
    return rows.where(vector.isNotNull()).select(col(id_col).alias("vec_id"), col(vector_col).alias("vector")).where((F.size("vector") > 0) & fine)


def moments(vectors: DataFrame, dimensions: int) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sum of each dimension, as Python integers."""

    def run(batches):
        n, sums = 0, np.zeros(dimensions, dtype=object)
        for batch in batches:
            x = fixed_point(batch.column(0), dimensions)
            n += len(x)
            # Exact: high and low halves are summed apart.
            sums = sums + ((x >> 26).sum(axis=0).astype(object) << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
        if n:
            kind = pa.list_(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[int(s) for s in sums]], kind)], names=["n", "sums"])

    parts = vectors.select("vector").mapInArrow(run, "n long, sums array<decimal(38,0)>")
    parts = parts.select("n", F.posexplode("sums").alias("at", "s"))
    total = parts.groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("at").collect()
    return (int(total[0]["n"]) if total else 0), np.array([int(r["s"]) for r in total], dtype=object)


def covariance_product(vectors: DataFrame, dimensions: int, n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The function that multiplies the covariance with a block of vectors, in one pass over the rows."""

    def product(block: np.ndarray) -> np.ndarray:
        def run(batches):
            total, seen = np.zeros(block.shape), False
            for batch in batches:
                c = centred(fixed_point(batch.column(0), dimensions), n, sums)
                total += c.T @ (c @ block)
                seen = True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

        parts = vectors.select("vector").mapInArrow(run, "v array<double>").withColumn("part", F.spark_partition_id())
        return sum_vectors(parts, "part", "v").reshape(block.shape) / n

    return product


def squares(vectors: DataFrame, dimensions: int, n: int, sums: np.ndarray) -> float:
    """The trace of the covariance."""

    def run(batches):
        total = [0.0]
        for batch in batches:
            c = centred(fixed_point(batch.column(0), dimensions), n, sums)
            total.append(float((c * c).sum()))
        yield pa.RecordBatch.from_arrays([pa.array([math.fsum(total)])], names=["t"])

    return vectors.select("vector").mapInArrow(run, "t double").agg(F.sum("t")).first()[0] / n


def orthonormal(block: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the orthonormal ``against``; twice, for full precision."""
    basis = np.hstack(against)
    block = block / np.maximum(np.linalg.norm(block, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        block, sizes, _ = np.linalg.svd(block, full_matrices=False)
        block = block[:, sizes > 1e-10]
    return block


def minres(apply: Callable, project: Callable, shifts: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of P (A - shift) P t = right, a column each, by ``steps`` of MINRES.

    Lanczos vectors, rotations and updates are kept per column; only the product with A is
    shared. A column whose Krylov space is exhausted stays as it is.
    """
    width = right.shape[1]
    beta = np.linalg.norm(right, axis=0)
    v_before, v = np.zeros_like(right), right / np.where(beta > 0, beta, 1)
    w_before, w = np.zeros_like(right), np.zeros_like(right)
    solution, eta, first = np.zeros_like(right), beta.copy(), beta.copy()
    cosines, sines = np.ones((2, width)), np.zeros((2, width))
    beta = np.zeros(width)
    going = first > 0
    for _ in range(steps):
        if not going.any():
            break
        z = project(apply(v) - v * shifts)
        alpha = (v * z).sum(axis=0)
        z = z - v * alpha - v_before * beta
        after = np.linalg.norm(z, axis=0)
        delta = cosines[0] * alpha - cosines[1] * sines[0] * beta
        rho = np.hypot(delta, after)
        safe = np.where(rho > 0, rho, 1)
        over = sines[0] * alpha + cosines[1] * cosines[0] * beta
        far = sines[1] * beta
        w_new = (v - w_before * far - w * over) / safe
        cosine, sine = delta / safe, after / safe
        going &= rho > EPS * np.abs(shifts).max()
        solution += np.where(going, cosine * eta, 0) * w_new
        eta = -sine * eta
        w_before, w = w, w_new
        cosines, sines = np.array([cosine, cosines[0]]), np.array([sine, sines[0]])
        v_before, v, beta = v, z / np.where(after > 0, after, 1), after
        going &= after > EPS * np.abs(shifts).max()
    return solution


def leading_eigenpairs(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric positive semidefinite matrix and their unit vectors.

    ``product`` multiplies the matrix, of ``size`` rows, with a block of columns. The result
    is in falling order; every residual is at most the rounding of such a product.
    """
    wanted = min(wanted, size)
    width = min(wanted + GUARDS, size)
    most = min(size, 6 * width)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    basis = orthonormal(np.random.default_rng(seed).standard_normal((size, width)), [locked])
    image = product(basis)
    for _ in range(OUTER):
        inner = basis.T @ image
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_image = basis @ turn, image @ turn
        residual = ritz_image - ritz * theta
        residual = residual - locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0)
        scale = max(theta.max(initial=0), values.max(initial=0))
        precise = sizes <= 4 * math.sqrt(size) * EPS * scale
        if basis.shape[1] + locked.shape[1] == size:
            precise[:] = True  # The subspace is the whole space: what is left is rounding.
        # Only leading pairs are locked, so that none of the wanted ones is passed over.
        lead = int(np.argmin(precise)) if not precise.all() else len(precise)
        if lead:
            locked, values = np.hstack([locked, ritz[:, :lead]]), np.concatenate([values, theta[:lead]])
            ritz, ritz_image, theta, residual, sizes = ritz[:, lead:], ritz_image[:, lead:], theta[lead:], residual[:, lead:], sizes[lead:]
        beyond = theta[0] + sizes[0] if len(theta) else 0.0
        if len(values) >= wanted and beyond <= np.sort(values)[::-1][wanted - 1] + EPS * size * scale:
            break
        if locked.shape[1] == size:
            break
        if ritz.shape[1] + width > most:
            ritz, ritz_image = ritz[:, : 2 * width], ritz_image[:, : 2 * width]
        basis, image = ritz, ritz_image
        active = min(width, len(theta)) or width
        kept = orthonormal(ritz[:, :active], [locked]) if len(theta) else np.zeros((size, 0))
        fixed = np.hstack([locked, kept])

        def project(block, fixed=fixed):
            return block - fixed @ (fixed.T @ block)

        if len(theta):
            corrections = minres(product, project, theta[:active], project(-residual[:, :active]), INNER)
        else:  # All of the subspace was locked before the wanted number was reached.
            corrections = np.random.default_rng(seed + locked.shape[1]).standard_normal((size, width))
        added = orthonormal(corrections, [locked, basis])
        if not added.shape[1]:
            added = orthonormal(np.random.default_rng(seed + 1).standard_normal((size, width)), [locked, basis])
        added = added[:, : size - locked.shape[1] - basis.shape[1]]
        basis, image = np.hstack([basis, added]), np.hstack([image, product(added)])
    else:
        raise RuntimeError("the eigenvectors did not reach double precision")
    order = np.argsort(-values, kind="stable")[:wanted]
    # Rayleigh-Ritz once more over the locked vectors, so that they are orthogonal among themselves.
    chosen = np.linalg.qr(locked[:, order])[0]
    inner = chosen.T @ product(chosen)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], (chosen @ turn)[:, ::-1]


def fit_whitening(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """Components of all ``vectors(vec_id, vector)``; None if there are none."""
    sizes = [r[0] for r in vectors.select(F.size("vector")).distinct().limit(2).collect()]
    if not sizes:
        return None
    if len(sizes) > 1:
        raise ValueError("vectors must have one length")
    n, sums = moments(vectors, sizes[0])
    trace = squares(vectors, sizes[0], n, sums)
    if trace == 0:
        return Whitening(n, sums, trace, np.zeros((sizes[0], 0)), np.zeros(0))
    values, found = leading_eigenpairs(covariance_product(vectors, sizes[0], n, sums), sizes[0], components)
    real = values > sizes[0] * 16 * EPS * values[0]
    return Whitening(n, sums, trace, found[:, real], values[real])


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity; both moments are centred."""
    size, k = len(model.sums), len(model.variances)
    scaled = model.vectors / np.sqrt(model.variances)

    def summed(each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches):
            total = 0.0
            for batch in batches:
                total = total + each(centred(fixed_point(batch.column(0), size), model.n, model.sums) @ scaled)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

        parts = vectors.select("vector").mapInArrow(run, "v array<double>").withColumn("part", F.spark_partition_id())
        return sum_vectors(parts, "part", "v") / model.n

    mean = summed(lambda w: w.sum(axis=0))
    cov = summed(lambda w: (w - mean).T @ (w - mean)).reshape(k, k)
    return float(np.abs(cov - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n*x - S)^2 of each row, exactly; None beyond 64 bits."""
    rough = ((x - (sums / n).astype(np.float64)) ** 2).sum(axis=1) * float(n) ** 2
    if n * (float(np.abs(x).max(initial=0)) + 1) < LONG_MAX / 2:
        d = n * x - sums.astype(np.int64)
        exact = (d * d).sum(axis=1).tolist()
        if rough.max(initial=0) < LONG_MAX / 4:
            return exact
    found = []
    for row, size in zip(x, rough, strict=True):
        value = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) if size < LONG_MAX * 2 else LONG_MAX + 1
        found.append(value if value <= LONG_MAX else None)
    return found


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null or empty, or hold a null or non-finite entry, are left out; all
    others are fitted and whitened, equal rows and rows that share an id each for itself (a null
    id stays null). Vectors of different lengths are refused. Components are numbered from 1 by
    falling variance, their sign is arbitrary but the same for all rows; components without
    variance, as with fewer vectors than components, can't be whitened and are not returned, so
    one vector, or equal ones, give no rows, like an empty table. ``deviation`` is null where it is beyond a long.
    Other columns are ignored.
    """
    vectors = usable_vectors(rows, id_col, vector_col)
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    many, size = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    # Small partitions are put together, as many passes are made over them.
    vectors = vectors.coalesce(max(1, -(-many * (size or 1) // ENTRIES_EACH)))
    model = fit_whitening(vectors, components)
    added = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = T.StructType([vectors.schema["vec_id"], *T._parse_datatype_string(added).fields])
    if model is None or not len(model.variances):
        return rows.sparkSession.createDataFrame([], schema)
    scaled, k = model.vectors / np.sqrt(model.variances), len(model.variances)
    explained, error = model.variances / model.trace, identity_error(vectors, model)
    n, sums = model.n, model.sums

    def run(batches):
        for batch in batches:
            x = fixed_point(batch.column(1), len(sums))
            m = len(x)
            repeated = pa.array(np.repeat(np.arange(m), k))
            arrays = [
                batch.column(0).take(repeated),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(deviations(x, n, sums), pa.int64()).take(repeated),
                pa.array((centred(x, n, sums) @ scaled).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return usable_vectors(rows, id_col, vector_col).mapInArrow(run, schema)
