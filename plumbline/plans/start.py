"""Starting points of a fit: singular vectors, random numbers or the caller's own factors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import draws, kernels
from plumbline.plans.passes import DRIVER_BYTES, Passes, Sums

# Columns of a block beyond the rank that is asked for, and of the space that is searched before it is cut back.
OVERSAMPLE = 10
SPACE = 400


class _Search:
    """Leading eigenvectors of one group's YᵀY: a space that grows by the image of its last block, a pass at a time.

    The space is cut back to its best part when it is large, and holds everything once it is as wide as the matrix.
    """

    def __init__(self, block: np.ndarray, k: int, tol: float):
        self.k, self.tol, self.settled = k, tol, False
        self.block = np.linalg.qr(block)[0]
        self.space, self.image = np.zeros((len(block), 0)), np.zeros((len(block), 0))

    def add(self, image: np.ndarray) -> None:
        """Take in YᵀY times the block and choose the next block."""
        wide = self.block.shape[1]
        self.space, self.image = np.hstack([self.space, self.block]), np.hstack([self.image, image])
        small = self.space.T @ self.image
        lam, u = np.linalg.eigh(0.5 * (small + small.T))
        lam, u = lam[::-1], u[:, ::-1]
        lead = u[:, : self.k]
        self.values, self.vectors = lam[: self.k], self.space @ lead
        rest = self.image @ lead - self.vectors * self.values
        m, largest = len(image), max(lam[0], 0.0)
        if self.space.shape[1] >= m or np.sqrt((rest * rest).sum(axis=0)).max() <= self.tol * largest:
            self.settled = True
            return
        new = image
        for _ in range(2):
            new = new - self.space @ (self.space.T @ new)
        if self.space.shape[1] + wide > max(SPACE, 4 * wide):
            kept = u[:, : self.k + wide]
            self.space, self.image = self.space @ kept, self.image @ kept
        left, size, _ = np.linalg.svd(new, full_matrices=False)
        self.block = left[:, size > np.finfo(float).eps * m * largest]
        self.settled = not self.block.shape[1]  # what is left is rounding


def top_singular(passes: Passes, ranks: dict[int, int], oversample: int = OVERSAMPLE, tol: float = 1e-12) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Leading singular values and right singular vectors of every group's uncentred matrix, whatever its width.

    Each pass sends out M x (K + oversample) numbers a group and sums as many. A group is done when all residuals
    of its leading eigenpairs are within ``tol`` of the largest eigenvalue, at the latest after M / (K + oversample) passes.
    """
    m = passes.width
    rng = np.random.default_rng(0)
    wide = min(m, max(ranks.values()) + oversample)
    start = rng.standard_normal((m, wide))
    each = max(1, DRIVER_BYTES // (8 * m * wide))  # as many groups at a time as the driver takes
    todo, out = sorted(ranks), {}
    for i in range(0, len(todo), each):
        some = todo[i : i + each]
        rows = passes.objects if len(todo) <= each else passes.objects.filter(F.col("grp").isin(some))
        found = {g: _Search(start[:, : min(m, ranks[g] + oversample)], ranks[g], tol) for g in some}
        while live := {g: s.block for g, s in found.items() if not s.settled}:
            told = passes.spark.sparkContext.broadcast(live)
            sums = passes.run(_sketch_step(told), {g: b.shape for g, b in live.items()}, rows=rows, keep=False)
            told.unpersist()
            for g in live:
                found[g].add(sums[g])
        out.update({g: (np.sqrt(np.maximum(s.values, 0.0)), s.vectors) for g, s in found.items()})
    return out


def _by_group(block: pa.RecordBatch):
    grp = block.column("grp").to_numpy()
    y = kernels.matrix(block.column("y"))
    for g in np.unique(grp):
        yield int(g), y[grp == g]


def _sketch_step(basis):
    def step(block: pa.RecordBatch, sums: Sums) -> None:
        for g, y in _by_group(block):
            if g in basis.value:
                sums.add(g, y.T @ (y @ basis.value[g]))

    return step


def random_coeffs(obj_id: Column, seed: int, k: int) -> Column:
    """K standard normal numbers for an object, from the seed and its id."""
    return F.array(*[draws.normal(f"{seed}/A", obj_id, F.lit(i)) for i in range(k)])


def random_basis(features: DataFrame, seed: int, k: int) -> DataFrame:
    """(feat_id, g) of standard normal numbers."""
    return features.select("feat_id", F.array(*[draws.normal(f"{seed}/G", F.col("feat_id"), F.lit(i)) for i in range(k)]).alias("g"))
