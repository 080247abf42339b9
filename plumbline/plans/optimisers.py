"""Optimisers of the gradient fit, and what one's own has to offer.

An optimiser works on rows: on the coefficients of a batch of objects inside a task, and on the basis on the driver.
The moments of an object lie in its row of the state table, those of the basis stay with the basis.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

Moments = tuple[np.ndarray, ...]


class Optimiser(Protocol):
    """``moments``: how many arrays, each of the shape of the parameters and zero at first, are carried from step to step.

    It is sent to the tasks, so it must pickle, and may keep nothing between calls but its settings.
    """

    moments: int

    def step(self, grad: np.ndarray, moments: Moments, n: int) -> tuple[np.ndarray, Moments]:
        """The raw step, which is subtracted, and the new moments. Elementwise: a task sees a part of the rows only.
        ``n`` counts the steps since the moments were zero."""

    def scale(self, step_mean2: float, parameter_mean2: float) -> float:
        """Factor on the raw steps, from the mean squares of all raw steps and of all parameters of a side (A or G)."""


@dataclass(frozen=True)
class Adafactor:
    """Steps by the running root mean square of the gradient, clipped in size and relative to the size of the parameters."""

    rate: float = 1e-3
    decay: float = 0.9
    eps: float = 1e-30
    clip: float = 1.0
    min_scale: float = 1e-3
    moments = 1

    def step(self, grad, moments, n):
        beta = 1.0 - (n + 1.0) ** -self.decay
        second = beta * moments[0] + (1.0 - beta) * (grad * grad + self.eps)
        return grad / np.sqrt(second), (second,)

    def scale(self, step_mean2, parameter_mean2):
        return self.rate / max(1.0, np.sqrt(step_mean2) / self.clip) * max(np.sqrt(parameter_mean2), self.min_scale)


@dataclass(frozen=True)
class Momentum:
    """Plain gradient descent with a running sum of gradients; ``beta=0`` is without."""

    rate: float
    beta: float = 0.9
    moments = 1

    def step(self, grad, moments, n):
        along = self.beta * moments[0] + grad
        return along, (along,)

    def scale(self, step_mean2, parameter_mean2):
        return self.rate
