"""Loss families: the robust weight and the loss of a cell, as Spark columns and as numpy twins.

A family is defined by what it does to ``u = w * r**2``, the squared residual in units of the
stated variance. Subclass ``Loss`` to add one; instances are sent to the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F


class Loss:
    def weight(self, w: Column, r: Column) -> Column:
        """Robust weight in (0, 1]."""
        raise NotImplementedError

    def loss(self, w: Column, r: Column) -> Column:
        raise NotImplementedError

    def weight_np(self, w: np.ndarray, r: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def loss_np(self, w: np.ndarray, r: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def total_weight(self, w: Column, r: Column) -> Column:
        return w * self.weight(w, r)


@dataclass(frozen=True)
class Gaussian(Loss):
    """Plain weighted least squares: every cell keeps its data weight."""

    def weight(self, w, r):
        return F.lit(1.0)

    def loss(self, w, r):
        return w * r * r

    def weight_np(self, w, r):
        return np.ones_like(r)

    def loss_np(self, w, r):
        return w * r * r


@dataclass(frozen=True)
class StudentT(Loss):
    """Student-t loss. Only ``q2 = nu * scale**2`` is identifiable, so both parameters fold into it."""

    nu: float = 1.0
    scale: float = 1.0

    def __post_init__(self):
        if not self.scale > 0:
            raise ValueError(f"scale must be positive, got {self.scale}")
        if not self.nu > 0:
            raise ValueError(f"nu must be positive, got {self.nu}")

    @property
    def q2(self) -> float:
        return self.nu * self.scale**2

    def weight(self, w, r):
        return F.lit(self.q2) / (F.lit(self.q2) + w * r * r)

    def loss(self, w, r):
        return F.lit(self.q2) * F.log1p(w * r * r / F.lit(self.q2))

    def weight_np(self, w, r):
        return self.q2 / (self.q2 + w * r * r)

    def loss_np(self, w, r):
        return self.q2 * np.log1p(w * r * r / self.q2)


@dataclass(frozen=True)
class Cauchy(StudentT):
    """Student-t with one degree of freedom; ``scale`` is the outlier threshold Q."""

    nu: float = 1.0

    def __init__(self, scale: float = 1.0):
        object.__setattr__(self, "nu", 1.0)
        object.__setattr__(self, "scale", scale)
        self.__post_init__()
