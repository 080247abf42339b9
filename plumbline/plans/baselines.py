"""Baselines without weights: principal components, and principal component pursuit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions import kernels
from plumbline.plans.passes import Passes, Sums
from plumbline.plans.start import top_singular
from plumbline.runtime import arrow_map

# The pursuit sends a features x features matrix to the tasks and sums one back.
PURSUIT_FEATURES = 4096


@dataclass
class Components:
    values: np.ndarray
    vectors: np.ndarray

    def project(self, objects: DataFrame) -> DataFrame:
        """Add the coefficients ``a`` and the reconstruction ``pred``. Narrow."""
        v = self.vectors

        def run(batches):
            for batch in batches:
                y = kernels.matrix(batch.column("y"))
                if len(y):
                    a = y @ v
                    yield pa.RecordBatch.from_arrays(
                        batch.columns + [kernels.lists(a), kernels.lists(a @ v.T)], names=batch.schema.names + ["a", "pred"]
                    )

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema.fields)
        return arrow_map(objects, run, f"{fields}, a array<double>, pred array<double>")


def principal_components(objects: DataFrame, k: int, buckets: int | None = None) -> Components:
    """Leading k right singular vectors of the uncentred matrix ``y``."""
    rows = objects.select(F.lit(0).alias("grp"), F.col("obj_id").cast("bigint").alias("obj_id"), "y")
    passes = Passes(rows, ["y"], buckets)
    if not 1 <= k <= min(passes.n_objects, passes.width):
        raise ValueError(f"rank {k} is outside 1 .. {min(passes.n_objects, passes.width)}")
    values, vectors = top_singular(passes, {0: k})[0]
    passes.scratch.drop("objects")
    return Components(values, vectors)


def embed(residuals: DataFrame, dims: int = 2, column: str = "r") -> DataFrame:
    """Low-dimensional embedding of residual vectors (bin, obj_id, r): e1, e2, ... on their own components.

    A component may point either way; it is turned so that its largest entry is positive.
    """
    numbered = residuals.withColumn("_id", F.xxhash64("bin", "obj_id"))
    pc = principal_components(numbered.select(F.col("_id").alias("obj_id"), F.col(column).alias("y")), dims)
    flip = np.where(pc.vectors[np.abs(pc.vectors).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    done = Components(pc.values, pc.vectors * flip).project(residuals.select("bin", "obj_id", F.col(column).alias("y")))
    return done.select("bin", "obj_id", *[F.col("a")[i].alias(f"e{i + 1}") for i in range(dims)])


@dataclass
class Pursuit:
    """Low-rank and sparse parts as arrays: (obj_id, l, s)."""

    parts: DataFrame
    n_iter: int
    error: float
    rank: int


def _clip(z: np.ndarray, t: float) -> np.ndarray:
    return np.clip(z, -t, t)


def _shrinker(gram: np.ndarray, tau: float) -> tuple[np.ndarray, int]:
    """Matrix P with X P = X after its singular values are lowered by tau, and the rank left."""
    lam, v = np.linalg.eigh(0.5 * (gram + gram.T))
    s = np.sqrt(np.maximum(lam, 0.0))
    kept = s > tau
    return (v[:, kept] * ((s[kept] - tau) / s[kept])) @ v[:, kept].T, int(kept.sum())


def _pursuit_step(told):
    """State of an object: z, from which sparse part and multiplier both follow (z minus and times its clip)."""

    def step(block: pa.RecordBatch, sums: Sums) -> np.ndarray:
        m = told.value
        d = kernels.matrix(block.column("y"))
        z = kernels.matrix(block.column("state")) if "state" in block.schema.names else np.zeros_like(d)
        t = m["tau"]
        low = (d - z + 2.0 * _clip(z, t)) @ m["p"]
        z = d - low + _clip(z, t)
        left = d - low - (z - _clip(z, t))
        x = d - z + 2.0 * _clip(z, t)
        sums.add(0, x.T @ x)
        sums.add(1, np.array([[(left * left).sum()]]))
        return np.hstack([z, low]) if m["last"] else z

    return step


def _size_step(block: pa.RecordBatch, sums: Sums) -> None:
    d = kernels.matrix(block.column("y"))
    sums.add(0, d.T @ d)
    sums.add(1, np.array([[np.abs(d).sum(), (d * d).sum()]]))


def pursuit(objects: DataFrame, mu: float | None = None, lam: float | None = None, tol: float | None = None, max_iter: int = 1000, buckets: int | None = None) -> Pursuit:
    """Split ``y`` into low-rank plus sparse by alternating directions, one pass an iteration.

    Singular values are lowered through the M x M Gram matrix of each iterate, so the features
    must number at most ``PURSUIT_FEATURES``; objects are unlimited.
    """
    if max_iter < 1:
        raise ValueError(f"max_iter must be at least 1, got {max_iter}")
    rows = objects.select(F.lit(0).alias("grp"), F.col("obj_id").cast("bigint").alias("obj_id"), "y")
    passes = Passes(rows, ["y"], buckets)
    n, m = passes.n_objects, passes.width
    if m > PURSUIT_FEATURES:
        raise ValueError(f"{m} features, at most {PURSUIT_FEATURES} are supported")
    sums = passes.run(_size_step, {0: (m, m), 1: (1, 2)}, keep=False)
    gram, (l1, l2) = sums[0], sums[1][0]
    mu = mu if mu is not None else n * m / (4.0 * l1)
    lam = lam if lam is not None else 1.0 / np.sqrt(max(n, m))
    tol = tol if tol is not None else 1e-7 * np.sqrt(l2)
    sc = passes.spark.sparkContext
    error, rank, i = np.inf, 0, 0
    while error > tol and i < max_iter:
        p, rank = _shrinker(gram, 1.0 / mu)
        told = sc.broadcast({"p": p, "tau": lam / mu, "last": False})
        before = passes.state
        sums = passes.run(_pursuit_step(told), {0: (m, m), 1: (1, 1)})
        gram, error = sums[0], float(np.sqrt(sums[1][0, 0]))
        i += 1
        if error > tol and i < max_iter:
            passes.forget_before()
    # the low-rank part of the last iteration follows from the state before it
    told = sc.broadcast({"p": p, "tau": lam / mu, "last": True})
    passes.state = before
    passes.run(_pursuit_step(told), {0: (m, m), 1: (1, 1)})
    tau = lam / mu
    z = F.slice("state", 1, m)
    sparse = F.transform(z, lambda x: F.signum(x) * F.greatest(F.abs(x) - F.lit(tau), F.lit(0.0)))
    parts = passes.state.select("obj_id", F.slice("state", m + 1, m).alias("l"), sparse.alias("s"))
    passes.forget_before(1)
    passes.scratch.drop("objects")
    return Pursuit(parts, i, error, rank)
