"""Object scores: one number summarising the robust weights of an object, low meaning anomalous.

A score is a function from the weight column to a column. Over cells it is an aggregate; a group
is one object, so it never holds more values than there are features. Over arrays the same
summaries are plain expressions on the array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

Score = Callable[[Column], Column]


def quantile(p: float) -> Score:
    return lambda w: F.percentile(w, F.lit(p))


def fraction_below(t: float) -> Score:
    return lambda w: F.avg((w < t).cast("double"))


def count_below(t: float, sign: int = 1) -> Score:
    return lambda w: F.lit(sign) * F.count_if(w < t)


CELL_SCORES: dict[str, Score] = {
    "median": quantile(0.5),
    "p01": quantile(0.01),
    "p10": quantile(0.10),
    "mean": F.avg,
    "min": F.min,
    "frac_low": fraction_below(0.5),
    "frac_ok": lambda w: F.lit(1.0) - fraction_below(0.5)(w),
    "n_low": count_below(0.3),
    "neg_n_low": count_below(0.3, sign=-1),
}


def array_quantile(p: float) -> Score:
    """Linear-interpolation quantile of an array column."""

    def score(w: Column) -> Column:
        ordered = F.array_sort(w)
        at = (F.size(w) - 1) * F.lit(p)
        low = F.floor(at).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(w) - 1))
        return a + (b - a) * (at - low)

    return score


def array_mean(w: Column) -> Column:
    return F.try_divide(F.aggregate(w, F.lit(0.0), lambda s, x: s + x), F.size(w))


def array_fraction_below(t: float) -> Score:
    return lambda w: F.try_divide(F.size(F.filter(w, lambda x: x < t)), F.size(w))


ARRAY_SCORES: dict[str, Score] = {
    "median": array_quantile(0.5),
    "p01": array_quantile(0.01),
    "p10": array_quantile(0.10),
    "mean": array_mean,
    "min": F.array_min,
    "frac_low": array_fraction_below(0.5),
    "frac_ok": lambda w: F.lit(1.0) - array_fraction_below(0.5)(w),
    "n_low": lambda w: F.size(F.filter(w, lambda x: x < 0.3)).cast("bigint"),
    "neg_n_low": lambda w: -F.size(F.filter(w, lambda x: x < 0.3)).cast("bigint"),
}


def _row_quantile(w: np.ndarray, used: np.ndarray | None, p: float) -> np.ndarray:
    """Linear-interpolation quantile of every row, of its used cells only; NaN without any."""
    if used is None:
        return np.quantile(w, p, axis=1)
    n = used.sum(axis=1)
    ordered = np.sort(np.where(used, w, np.inf), axis=1)
    at = np.maximum(n - 1, 0) * p
    low = np.floor(at).astype(int)
    rows = np.arange(len(w))
    a, b = ordered[rows, low], ordered[rows, np.minimum(low + 1, np.maximum(n - 1, 0))]
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, a + (b - a) * (at - low), np.nan)


def _row_mean(x: np.ndarray, used: np.ndarray | None) -> np.ndarray:
    if used is None:
        return x.mean(axis=1)
    with np.errstate(invalid="ignore"):
        return np.where(used, x, 0).sum(axis=1) / used.sum(axis=1)


def _row_count(x: np.ndarray, used: np.ndarray | None) -> np.ndarray:
    return (x if used is None else x & used).sum(axis=1)


# The same on a matrix of weights, one row an object, with a mask of the cells that take part.
MATRIX_SCORES = {
    "median": lambda w, u: _row_quantile(w, u, 0.5),
    "p01": lambda w, u: _row_quantile(w, u, 0.01),
    "p10": lambda w, u: _row_quantile(w, u, 0.10),
    "mean": _row_mean,
    "min": lambda w, u: (w if u is None else np.where(u, w, np.inf)).min(axis=1),
    "frac_low": lambda w, u: _row_mean((w < 0.5).astype(float), u),
    "frac_ok": lambda w, u: 1.0 - _row_mean((w < 0.5).astype(float), u),
    "n_low": lambda w, u: _row_count(w < 0.3, u),
    "neg_n_low": lambda w, u: -_row_count(w < 0.3, u),
}
