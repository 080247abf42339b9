"""Gradient fit of the same loss on A and G, by Adafactor or an optimiser of one's own.

A cycle is one pass: a task moves the coefficients of its objects and adds up the basis gradient.
The step of A is scaled by two numbers over all objects, its mean square and that of A; they
are known after the pass and applied at the start of the next one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.functions import kernels
from plumbline.plans.fit import FittedModel, ModelSpec, Settings, _finish_step, _first_rows, _own_start, _rotation, _start, stops
from plumbline.plans.optimisers import Adafactor, Optimiser
from plumbline.plans.passes import Passes, Sums


def _taken(told: dict, state: np.ndarray, k: int, moments: int) -> np.ndarray:
    """Coefficients after the step still pending."""
    at = k * (1 + moments)
    return (state[:, :k] - told["factor"] * state[:, at : at + k]) @ told["t"]


def _grad_step(told, k: int, optimiser: Optimiser, remember: bool):
    """State vector of an object: coefficients, moments, the raw step not yet taken and, to ``remember``, the coefficients
    at the check before."""
    moments = optimiser.moments

    def step(block: pa.RecordBatch, sums: Sums) -> np.ndarray:
        m = told.value
        y, w = kernels.matrix(block.column("y")), kernels.matrix(block.column("w"))
        g, loss = m["g"], m["loss"]
        held = tuple(np.zeros((len(y), k)) for _ in range(moments))
        seen = None
        if m["start"] is not None:
            a = y @ m["start"]
        elif "state" not in block.schema.names:
            a = kernels.a_step(y, w, g)
        else:
            s = kernels.matrix(block.column("state"))
            if s.shape[1] == k:
                a = s
            else:
                a = _taken(m, s, k, moments)
                seen = s[:, -k:] if remember else None
                if not m["reset"]:
                    held = tuple(np.hsplit(s[:, k : k * (1 + moments)], moments)) if moments else ()
        if m["compare"]:
            sums.top(2, float(((a - seen) ** 2).max()))
        r = y - a @ g.T
        trust = loss.weight_np(w, r)
        pull = -2.0 * w * trust * r
        u, held = optimiser.step(pull @ g, held, m["n"])
        sums.add(0, pull.T @ a)
        # what the next rotation needs is the Gram matrix of a - f u, whose f is not known yet
        sums.add(1, np.hstack([a.T @ a, a.T @ u, u.T @ u]))
        bad = np.isnan(a).sum(), np.isnan(w * trust).sum()
        sums.add(2, np.array([[loss.loss_np(w, r).sum(), (u * u).sum(), (a * a).sum(), a.size, *bad]]))
        return np.hstack([a, *held, u] + ([a if seen is None or m["note"] else seen] if remember else []))

    return step


def _settle_step(told, k: int, moments: int):
    """Take the step still pending, so that the state is plain coefficients; a last comparison, if one is due."""

    def step(block: pa.RecordBatch, sums: Sums) -> np.ndarray:
        s = kernels.matrix(block.column("state"))
        a = _taken(told.value, s, k, moments)
        if told.value["compare"]:
            sums.add(0, np.array([[(a * a).sum()]]))
            sums.top(0, float(((a - s[:, -k:]) ** 2).max()))
        return a

    return step


def fit_gradient(
    objects: DataFrame, spec: ModelSpec, settings: Settings, init: dict | None, rate: float = 1e-3, buckets: int | None = None,
    rotate_every: int | None = None, optimiser: Optimiser | None = None,
) -> FittedModel:
    """Fit ``objects(grp, obj_id, y, w)`` by gradient steps.

    A rotation starts the moments afresh; by default there is none before the end. Without an ``optimiser``
    it is Adafactor at the given rate. A fit whose numbers go bad (NaN) stops there; ``nan_counts`` tells where.
    """
    optimiser = optimiser or Adafactor(rate)
    settings, init = _own_start(objects, [spec], settings, init)
    passes = Passes(objects, ["y", "w"], buckets)
    sc = passes.spark.sparkContext
    k, m = spec.k, passes.width
    remember = settings.conv == "max_frac_A"
    turn = _start(passes, [spec], settings, init or {})[0]
    rows = _first_rows(passes, [turn], k, settings, init or {})

    def nothing() -> tuple[np.ndarray, ...]:
        return tuple(np.zeros((m, k)) for _ in range(optimiser.moments))

    def is_check(i: int) -> bool:
        return i > 0 and i % settings.check_every == 0

    g, held, t, factor, losses, bads, seen, done = turn.g, nothing(), np.eye(k), 0.0, [], [], turn.g, False
    seen_loss, start, fresh, since = np.inf, turn.start, False, 0
    n = 0
    for i in range(settings.max_iter):
        # coefficients in hand are those after step i - 1; they are compared and remembered if that was a check
        due = remember and is_check(i - 1)
        told = sc.broadcast({
            "g": g, "loss": spec.loss, "n": since, "start": start, "t": t, "factor": factor, "reset": fresh, "compare": due, "note": due,
        })
        sums = passes.run(_grad_step(told, k, optimiser, remember), {0: (m, k), 1: (k, 3 * k), 2: (1, 6)}, rows=rows)
        passes.forget_before()
        rows, start, fresh = None, None, False
        loss, u2, a2, size, bad_a, bad_w = sums[2][0]
        if due and sums[-3][0] / (a2 / size) < settings.tol:
            # step i - 1 was the last one; the state holds its coefficients, and the step just found is not taken
            done, factor, t = True, 0.0, np.eye(k)
            break
        losses.append(loss)
        ug, held = optimiser.step(sums[0], held, since)
        g = g - optimiser.scale((ug * ug).mean(), (g * g).mean()) * ug
        factor, t, n, since = optimiser.scale(u2 / size, a2 / size), np.eye(k), i + 1, since + 1
        bads.append((int(bad_a), int(np.isnan(g).sum()), int(bad_w)))
        if any(bads[-1]):
            break
        if rotate_every and i and i % rotate_every == 0 and settings.rotation != "identity":
            aa, au, uu = np.hsplit(sums[1], 3)
            gram_a = aa - factor * (au + au.T) + factor**2 * uu
            t, back = _rotation(settings, gram_a, g.T @ g)
            g, held, fresh, since = g @ back, nothing(), True, 0
        if is_check(i):
            if settings.conv == "rel_frac_loss":
                done = abs(seen_loss - loss) / abs(loss) < settings.tol
            else:
                done = stops(settings, n, g, seen, losses)
            seen, seen_loss = g, loss
            if done:
                break
    due = remember and not done and is_check(n - 1)
    told = sc.broadcast({"t": t, "factor": factor, "compare": due})
    sums = passes.run(_settle_step(told, k, optimiser.moments), {0: (1, 1)} if due else {})
    if due:
        done = bool(sums[-1][0] / (sums[0][0, 0] / size) < settings.tol)
    turn.g, turn.t = g, np.eye(k)
    told = sc.broadcast([turn.told()])
    sums = passes.run(_finish_step(told, k), {turn.scalars: (1, 3)})
    final = passes.state
    passes.forget_before(1)
    passes.scratch.drop("objects")
    losses.append(sums[turn.scalars][0][0])
    coeffs = final.selectExpr("obj_id", f"if(state[{k}] > 0, slice(state, 1, {k}), null) as a", f"cast(state[{k}] as int) as n_valid")
    # like the alternating fit, one loss a cycle: the one after it
    return FittedModel(passes.spark, spec, g, coeffs, [float(x) for x in losses[1:]], n, bool(done), settings.ridge, nan_history=bads)
