"""Scoring with the basis held fixed: narrow, no shuffle, the same on a table and on a stream.

The basis (features x K) is sent to the tasks; an object's coefficients depend on nothing else.
One map does it all and sends back only what is asked for: a score costs its object one number on
the way out, not its arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from plumbline.functions import kernels
from plumbline.functions.scores import ARRAY_SCORES, MATRIX_SCORES
from plumbline.plans.passes import blocks
from plumbline.runtime import arrow_map

DATA = ("y", "w")
# What a map can add to an object, with its type.
OUTPUTS = {
    "a": "array<double>", "n_steps": "int", "n_valid": "int",
    "pred": "array<double>", "r": "array<double>", "w_rob": "array<double>", "loss_history": "array<double>",
}
STOPS = ("max_frac_A", "rel_frac_loss", "none")


def _nullable(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Lists, null where the object has no valid cell."""
    full = kernels.lists(rows)
    return pa.ListArray.from_arrays(full.offsets, full.values, mask=pa.array(~valid)) if len(rows) else full


def _given(lists: pa.Array, k: int) -> np.ndarray:
    """Coefficients as they come; an object without any is predicted as zero, its cells are all missing anyway."""
    a = np.zeros((len(lists), k))
    has = np.asarray(lists.is_valid())
    if has.any():
        a[has] = kernels.matrix(lists.drop_null())
    return a


def evaluate(
    objects: DataFrame,
    model,
    outputs: tuple[str, ...],
    scores: tuple[str, ...] = (),
    missing: str = "count",
    infer: bool = True,
    keep: tuple[str, ...] = (),
    max_iter: int = 100,
    tol: float = 1e-3,
    check_every: int = 10,
    n_steps: int | None = None,
    conv: str = "max_frac_A",
) -> DataFrame:
    """Objects' plain columns and those in ``keep``, with the ``outputs`` and named ``scores`` of the model.

    Coefficients are inferred, or read from ``a`` with ``infer=False``. Every object stops by
    itself, so the answer does not depend on batches or partitions: when its coefficients have settled, or its loss
    (``conv="rel_frac_loss"``), or after ``max_iter`` steps (``"none"``). ``n_steps`` runs exactly that
    many reweightings instead. The output ``loss_history`` has an object's losses at the start and at every check.
    """
    if conv not in STOPS:
        raise ValueError(f"conv must be one of {STOPS}, got {conv!r}")
    if not infer and "loss_history" in outputs:
        raise ValueError("loss_history belongs to an inference")
    g, loss, ridge = model.g, model.loss, model.ridge
    if n_steps is not None:
        max_iter, tol = n_steps, 0.0
    arrays = (*DATA, "a") if not infer else DATA
    plain = [c for c in objects.columns if c not in arrays or c in keep]
    weigh = bool({"pred", "r", "w_rob"} & set(outputs) or scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, len(g)):
                if not block.num_rows:
                    continue
                y, w = kernels.matrix(block.column("y")), kernels.matrix(block.column("w"))
                n_valid = (w > 0).sum(axis=1).astype(np.int32)
                found = {"n_valid": pa.array(n_valid)}
                if infer:
                    history = [] if "loss_history" in outputs else None
                    a, steps = kernels.irls(y, w, g, loss, ridge, max_iter, tol, check_every, conv, history)
                    found["n_steps"] = pa.array(steps)
                    if history is not None:
                        found["loss_history"] = pa.array(history, pa.list_(pa.float64()))
                else:
                    a = _given(block.column("a"), g.shape[1])
                if "a" in outputs:
                    found["a"] = _nullable(a, n_valid > 0)
                if weigh:
                    pred = a @ g.T
                    r = y - pred
                    w_rob = loss.weight_np(w, r)
                    for name, value in (("pred", pred), ("r", r), ("w_rob", w_rob)):
                        if name in outputs:
                            found[name] = kernels.lists(value)
                    used = None if missing == "count" else w > 0
                    found.update({s: pa.array(MATRIX_SCORES[s](w_rob, used)) for s in scores})
                names = plain + list(outputs) + list(scores)
                yield pa.RecordBatch.from_arrays([block.column(c) if c in plain else found[c] for c in names], names=names)

    fields = [objects.schema[c] for c in plain]
    extra = [f"{o} {OUTPUTS[o]}" for o in outputs] + [f"{s} {'bigint' if s.endswith('n_low') else 'double'}" for s in scores]
    schema = StructType(fields + (StructType.fromDDL(", ".join(extra)).fields if extra else []))
    return arrow_map(objects, run, schema)


def infer(objects: DataFrame, model, with_data: bool = False, history: bool = False, **options) -> DataFrame:
    """Add ``a``, ``n_steps`` and ``n_valid``, with ``history`` also ``loss_history``; the arrays ``y`` and ``w`` are dropped
    unless asked for."""
    outputs = ("a", "n_steps", "n_valid", "loss_history") if history else ("a", "n_steps", "n_valid")
    return evaluate(objects, model, outputs, keep=DATA if with_data else (), **options)


def apply(objects: DataFrame, model) -> DataFrame:
    """Add the arrays ``pred``, ``r`` and ``w_rob`` to objects with ``y``, ``w`` and ``a``."""
    return evaluate(objects, model, ("pred", "r", "w_rob"), infer=False, keep=(*DATA, "a"))


def infer_and_apply(objects: DataFrame, model, **options) -> DataFrame:
    """Inferred coefficients and everything that follows from them, in one map."""
    return evaluate(objects, model, tuple(o for o in OUTPUTS if o != "loss_history"), keep=DATA, **options)


def reconstruct(coeffs: DataFrame, model, only: DataFrame | None = None) -> DataFrame:
    """``pred`` arrays from coefficients alone, optionally for the objects in ``only``."""
    if only is not None:
        coeffs = coeffs.join(only.select("obj_id"), "obj_id", "left_semi")
    g = model.g

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, len(g)):
                if block.num_rows:
                    pred = kernels.matrix(block.column("a")) @ g.T
                    yield pa.RecordBatch.from_arrays([block.column("obj_id"), kernels.lists(pred)], names=["obj_id", "pred"])

    given = coeffs.filter(F.col("a").isNotNull()).select("obj_id", "a")
    id_type = given.schema["obj_id"].dataType.simpleString()
    return arrow_map(given, run, f"obj_id {id_type}, pred array<double>")


def score(
    objects: DataFrame,
    model,
    scores: dict | tuple[str, ...] = ("p01",),
    threshold: float = 0.5,
    missing: str = "count",
    **options,
) -> DataFrame:
    """Score objects with the model's basis: ``n_valid``, ``n_steps``, the scores and a flag.

    ``scores`` names entries of ``ARRAY_SCORES``, which are computed where the weights are, or maps
    names to expressions of the user's own on the weight array. The first one decides
    ``is_outlier`` (strictly below the threshold). Low is anomalous.
    """
    if missing not in ("count", "skip"):
        raise ValueError(f"missing must be 'count' or 'skip', got {missing!r}")
    first = next(iter(scores))
    if not isinstance(scores, dict):
        if unknown := [s for s in scores if s not in ARRAY_SCORES]:
            raise ValueError(f"unknown scores {unknown}; there are {sorted(ARRAY_SCORES)}")
        out = evaluate(objects, model, ("n_valid", "n_steps"), tuple(scores), missing, **options)
    else:
        done = evaluate(objects, model, ("n_valid", "n_steps", "w_rob"), keep=("w",), **options)
        weights = F.col("w_rob")
        if missing == "skip":
            weights = F.transform(F.filter(F.arrays_zip("w_rob", "w"), lambda c: c["w"] > 0), lambda c: c["w_rob"])
        rest = [c for c in done.columns if c not in ("w", "w_rob")]
        done = done.withColumn("_w", weights)
        out = done.select(*rest, *[f(F.col("_w")).alias(n) for n, f in scores.items()])
    return out.withColumn("is_outlier", F.col(first) < threshold)
