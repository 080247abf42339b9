"""Known data for the fits, and results as matrices."""

import numpy as np


class Problem:
    """Known low-rank data with uneven noise, gaps and gross errors."""

    def __init__(self, n=240, m=40, k=3, seed=0, missing=0.05, bad=0.01):
        rng = np.random.default_rng(seed)
        self.a, self.g = rng.normal(size=(n, k)), rng.normal(size=(m, k))
        sigma = rng.uniform(0.05, 0.2, size=(n, m))
        self.clean = self.a @ self.g.T
        self.y = self.clean + rng.normal(size=(n, m)) * sigma
        self.bad = rng.uniform(size=(n, m)) < bad
        self.y[self.bad] += 5.0
        self.w = 1 / sigma**2
        gone = rng.uniform(size=(n, m)) < missing
        self.y[gone], self.w[gone] = 0.0, 0.0
        self.bad &= ~gone
        self.n, self.m, self.k = n, m, k

    def frame(self, spark, parts=5):
        rows = [(i, self.y[i].tolist(), self.w[i].tolist()) for i in range(self.n)]
        return spark.createDataFrame(rows, "obj_id bigint, y array<double>, w array<double>").repartition(parts)


def arrays(df, column, key="obj_id"):
    """A column of arrays as a matrix in key order."""
    return np.array([r[column] for r in sorted(df.select(key, column).collect(), key=lambda r: r[key])])
