"""Rotations that fix the gauge of A Gᵀ. All work from K x K Gram matrices on the driver.

Each returns (T, H): the new coefficients are A T and the new basis is G H, with A Gᵀ unchanged.
"""

from __future__ import annotations

import numpy as np


def identity(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.eye(k), np.eye(k)


def whiten(gram_a: np.ndarray, gram_g: np.ndarray, target: str = "G", whiten: bool = True, eps: float = 1e-6):
    """Make the target matrix orthonormal by its symmetric inverse root, or only turn it to its axes."""
    if target not in ("A", "G", "none"):
        raise ValueError(f"target must be 'A', 'G' or 'none', got {target!r}")
    gram = gram_g if target == "G" else gram_a
    lam, v = np.linalg.eigh(0.5 * (gram + gram.T) + eps * np.eye(len(gram)))
    lam = np.maximum(lam, eps)
    if whiten:
        forward, back = (v / np.sqrt(lam)) @ v.T, (v * np.sqrt(lam)) @ v.T
    else:
        forward = back = v
    return (back, forward) if target == "G" else (forward, back)


def principal(gram_a: np.ndarray, gram_g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal basis ordered by singular value: the SVD of the product, from the two Grams."""
    lam, v = np.linalg.eigh(0.5 * (gram_g + gram_g.T))
    lam = np.maximum(lam, np.finfo(float).tiny)
    root = np.sqrt(lam)[:, None] * v.T
    s2, u = np.linalg.eigh(root @ gram_a @ root.T)
    u = u[:, np.argsort(s2)[::-1]]
    turn = (v / np.sqrt(lam)) @ u
    # an axis may point either way: keep the one nearest to where it was, or a settled basis would flip for ever
    u = u * np.where(turn[np.abs(turn).argmax(axis=0), np.arange(len(lam))] < 0, -1.0, 1.0)
    return root.T @ u, (v / np.sqrt(lam)) @ u
