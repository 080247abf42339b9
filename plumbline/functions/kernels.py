"""The small linear-algebra kernels that run on one Arrow batch of objects.

Normal matrices are kept packed (upper triangle, K(K+1)/2 columns), so that building them for
all rows or all features of a batch is one matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from plumbline.functions.losses import Loss


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """An Arrow list column of equal-length rows as a 2-D array."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(rows: np.ndarray) -> pa.Array:
    """A 2-D array as an Arrow list column."""
    n, m = rows.shape
    offsets = np.arange(0, n * m + 1, m, dtype=np.int32) if m else np.zeros(n + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def pack(x: np.ndarray) -> np.ndarray:
    """Row-wise products x_k x_l for k <= l."""
    i, j = np.triu_indices(x.shape[1])
    return x[:, i] * x[:, j]


def unpack(p: np.ndarray, k: int) -> np.ndarray:
    i, j = np.triu_indices(k)
    full = np.empty((p.shape[0], k, k))
    full[:, i, j] = p
    full[:, j, i] = p
    return full


# Eigenvalues of a normal matrix below this part of its largest count as zero.
RANK_CUT = 1e-12


def solve_packed(xp: np.ndarray, b: np.ndarray, ridge: float | None = None) -> np.ndarray:
    """Solve one K x K system a row: the shortest least-squares solution, whatever the row's rank.

    Every row is solved by itself through its eigenvalues, so that an answer depends on no other row of the batch.
    A row without data gives zeros, one that is not finite NaN.
    """
    k = b.shape[1]
    x = unpack(xp, k)
    if ridge:
        x += ridge * np.eye(k)
    bad = ~(np.isfinite(x).all(axis=(1, 2)) & np.isfinite(b).all(axis=1))
    x[bad] = 0.0
    if k == 1:
        lam, v = x[:, 0], np.ones((len(x), 1, 1))
    else:
        lam, v = np.linalg.eigh(x)
    held = lam > RANK_CUT * lam[:, -1:]
    along = np.einsum("nji,nj->ni", v, b)
    out = np.einsum("nij,nj->ni", v, np.divide(along, lam, out=np.zeros_like(along), where=held))
    out[bad] = np.nan
    return out


def a_step(y: np.ndarray, w: np.ndarray, g: np.ndarray, ridge: float | None = None) -> np.ndarray:
    """Weighted least-squares coefficients of every row on the basis g (M x K)."""
    return solve_packed(w @ pack(g), (w * y) @ g, ridge)


def g_sums(y: np.ndarray, w: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Per-feature normal sums of a batch: M x (K(K+1)/2 + K), packed matrix then right side."""
    return np.hstack([w.T @ pack(a), (w * y).T @ a])


def irls(
    y: np.ndarray,
    w: np.ndarray,
    g: np.ndarray,
    loss: Loss,
    ridge: float | None = None,
    max_iter: int = 100,
    tol: float = 1e-3,
    cadence: int = 10,
    conv: str = "max_frac_A",
    history: list | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients with the basis held fixed, reweighting until each object has settled.

    Every ``cadence`` steps an object is compared with itself at the previous check: its coefficients
    (``max_frac_A``) or its loss (``rel_frac_loss``). ``none`` or ``tol <= 0`` always run all the steps. Returns
    the coefficients and the steps each object took; a list given as ``history`` gets each object's losses, before the
    first step and at every check.
    """
    a = a_step(y, w, g, ridge)
    steps = np.zeros(len(a), dtype=np.int32)
    live = np.arange(len(a))
    by_loss = conv == "rel_frac_loss"
    losses = lambda at: loss.loss_np(w[at], y[at] - a[at] @ g.T).sum(axis=1)
    seen = a.copy()
    seen_loss = losses(live) if by_loss or history is not None else None
    if history is not None:
        history.extend([x] for x in seen_loss.tolist())
    for i in range(max_iter):
        if not len(live):
            break
        yl, wl = y[live], w[live]
        r = yl - a[live] @ g.T
        a[live] = a_step(yl, wl * loss.weight_np(wl, r), g, ridge)
        steps[live] += 1
        if i and i % cadence == 0:
            if seen_loss is not None:
                now_loss = losses(live)
                if history is not None:
                    for j, x in zip(live.tolist(), now_loss.tolist()):
                        history[j].append(x)
            if conv == "none" or tol <= 0:
                continue
            if by_loss:
                settled = np.abs(seen_loss[live] - now_loss) <= tol * np.abs(now_loss)
                seen_loss[live] = now_loss
            else:
                now = a[live]
                settled = ((now - seen[live]) ** 2).max(axis=1) <= tol * (now**2).mean(axis=1)
                seen[live] = now
            live = live[~settled]
    return a, steps
