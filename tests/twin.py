"""Plain numpy versions of the iterations, one object or feature at a time, to compare with."""

import numpy as np


def q2_weight(w, r, q2):
    return q2 / (q2 + w * r * r)


def q2_loss(w, r, q2):
    return float(q2 * np.log1p(w * r * r / q2).sum())


def lstsq_rows(y, w, g):
    out = np.zeros((len(y), g.shape[1]))
    for i in range(len(y)):
        s = np.sqrt(w[i])[:, None]
        out[i] = np.linalg.lstsq(g * s, y[i] * s[:, 0], rcond=None)[0]
    return out


def svd_start(y, k):
    u, s, vt = np.linalg.svd(y, full_matrices=False)
    return u[:, :k] * np.sqrt(s[:k]), vt[:k].T * np.sqrt(s[:k])


def fit(y, w, k, q2, steps, robust=True, each=False, start=None):
    a, g = start if start is not None else svd_start(y, k)
    history = []
    for _ in range(steps):
        wt = w * q2_weight(w, y - a @ g.T, q2) if robust else w
        a = lstsq_rows(y, wt, g)
        if each:
            wt = w * q2_weight(w, y - a @ g.T, q2)
        g = lstsq_rows(y.T, wt.T, a)
        r = y - a @ g.T
        history.append(q2_loss(w, r, q2) if robust else float((w * r * r).sum()))
    return a, g, history


def infer(y, w, g, q2, steps):
    a = lstsq_rows(y, w, g)
    for _ in range(steps):
        a = lstsq_rows(y, w * q2_weight(w, y - a @ g.T, q2), g)
    return a


def pursuit(d, steps, mu=None, lam=None):
    mu = mu or d.size / (4 * np.abs(d).sum())
    lam = lam or 1 / np.sqrt(max(d.shape))
    low, sparse, mult = np.zeros_like(d), np.zeros_like(d), np.zeros_like(d)
    for _ in range(steps):
        u, s, vt = np.linalg.svd(d - sparse + mult / mu, full_matrices=False)
        low = (u * np.maximum(s - 1 / mu, 0)) @ vt
        t = d - low + mult / mu
        sparse = np.sign(t) * np.maximum(np.abs(t) - lam / mu, 0)
        mult = mult + mu * (d - low - sparse)
    return low, sparse, float(np.sqrt(((d - low - sparse) ** 2).sum()))
