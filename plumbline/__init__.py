"""Robust low-rank modelling and anomaly scoring of large tables, on Spark."""

from plumbline.functions.losses import Cauchy, Gaussian, Loss, StudentT
from plumbline.plans.fit import Factorizer, FittedModel, ModelSpec, fit_many

__all__ = [
    "Cauchy",
    "Factorizer",
    "FittedModel",
    "Gaussian",
    "Loss",
    "ModelSpec",
    "StudentT",
    "fit_many",
]
