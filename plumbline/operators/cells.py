"""The model on the cell layout: half steps, reconstruction, weights and losses as column work.

For ragged data and for checking against SQL. Coefficients are (obj_id, a ARRAY<DOUBLE>), the
basis is (feat_id, g ARRAY<DOUBLE>). The basis has one row a feature and is broadcast when it is
proven small; the coefficients join on obj_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import kernels, measure
from plumbline.functions.losses import Loss
from plumbline.runtime import arrow_map, pin_small


def dot(a: Column, g: Column, k: int) -> Column:
    out = a[0] * g[0]
    for i in range(1, k):
        out = out + a[i] * g[i]
    return out


def with_basis(cells: DataFrame, basis: DataFrame, how: str = "inner") -> DataFrame:
    return cells.join(pin_small(basis.select("feat_id", "g")), "feat_id", how)


def with_coeffs(cells: DataFrame, coeffs: DataFrame, how: str = "inner") -> DataFrame:
    # hashing the few coefficients of a partition spares the cells a sort; laid out alike, neither side moves
    return cells.join(coeffs.select("obj_id", "a").hint("shuffle_hash"), "obj_id", how)


def with_prediction(cells: DataFrame, coeffs: DataFrame, basis: DataFrame, k: int) -> DataFrame:
    """Add ``pred`` (the reconstruction) and ``r`` (the residual) to every cell.

    Cells of a feature or an object without any data are predicted as zero; they are all missing.
    """
    joined = with_coeffs(with_basis(cells, basis, "left"), coeffs, "left")
    pred = F.coalesce(dot(F.col("a"), F.col("g"), k), F.lit(0.0))
    return joined.withColumn("pred", pred).withColumn("r", F.col("y") - F.col("pred")).drop("a", "g")


def with_weights(cells: DataFrame, loss: Loss) -> DataFrame:
    """Add ``w_rob``, ``w_tot`` and ``z`` to cells that carry ``w`` and ``r``."""
    w, r = F.col("w"), F.col("r")
    return (
        cells.withColumn("w_rob", loss.weight(w, r))
        .withColumn("w_tot", w * F.col("w_rob"))
        .withColumn("z", measure.z_score(r, w, F.col("w_rob")))
    )


def _normal_sums(weight: Column, y: Column, v: Column, k: int) -> list[Column]:
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    return [F.sum(weight * v[i] * v[j]).alias(f"x_{i}_{j}") for i, j in pairs] + [
        F.sum(weight * y * v[i]).alias(f"b_{i}") for i in range(k)
    ]


def _solve(sums: DataFrame, key: str, out: str, k: int, ridge: float | None) -> DataFrame:
    """Solve the K x K system of every row: closed form for K <= 2, Arrow batches beyond."""
    eps = F.lit(float(ridge or 0.0))
    if k == 1:
        value = F.array(F.try_divide(F.col("b_0"), F.col("x_0_0") + eps))
    elif k == 2:
        p, q, s = F.col("x_0_0") + eps, F.col("x_0_1"), F.col("x_1_1") + eps
        det, trace = p * s - q * q, p + s
        # det / trace**2 is the ratio of the eigenvalues; a matrix of rank one is trace * u u^T, and X b / trace**2 solves it
        full = det > F.lit(kernels.RANK_CUT) * trace * trace
        b0, b1 = F.col("b_0"), F.col("b_1")
        value = F.array(
            F.when(full, F.try_divide(s * b0 - q * b1, det)).otherwise(F.try_divide(p * b0 + q * b1, trace * trace)),
            F.when(full, F.try_divide(p * b1 - q * b0, det)).otherwise(F.try_divide(q * b0 + s * b1, trace * trace)),
        )
    else:
        return _solve_batches(sums, key, out, k, ridge)
    return sums.select(key, F.when(F.col("n_valid") > 0, value).alias(out), "n_valid")


def _solve_batches(sums: DataFrame, key: str, out: str, k: int, ridge: float | None) -> DataFrame:
    xs = [f"x_{i}_{j}" for i in range(k) for j in range(i, k)]
    bs = [f"b_{i}" for i in range(k)]
    key_type = sums.schema[key].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in xs])
            b = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in bs])
            v = kernels.solve_packed(x, b, ridge)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), kernels.lists(v), batch.column("n_valid")], names=[key, out, "n_valid"]
            )

    solved = arrow_map(sums, solve, f"{key} {key_type}, {out} array<double>, n_valid bigint")
    return solved.withColumn(out, F.when(F.col("n_valid") > 0, F.col(out)))


def _step(joined: DataFrame, key: str, vec: str, out: str, weight: str, k: int, ridge: float | None) -> DataFrame:
    w, y, v = F.col(weight), F.col("y"), F.col(vec)
    sums = joined.groupBy(key).agg(*_normal_sums(w, y, v, k), F.count_if(w > 0).alias("n_valid"))
    return _solve(sums, key, out, k, ridge)


def a_step(cells: DataFrame, basis: DataFrame, k: int, weight: str = "w", ridge: float | None = None) -> DataFrame:
    """Coefficients of every object given the basis: partial sums, then one shuffle on obj_id."""
    return _step(with_basis(cells, basis), "obj_id", "g", "a", weight, k, ridge)


def g_step(cells: DataFrame, coeffs: DataFrame, k: int, weight: str = "w", ridge: float | None = None) -> DataFrame:
    """Basis given the coefficients. Partial sums before the shuffle, so a feature's N cells never meet."""
    return _step(with_coeffs(cells, coeffs), "feat_id", "a", "g", weight, k, ridge)


def mean_basis(cells: DataFrame) -> DataFrame:
    """Rank-one start: the weighted mean of every feature, i.e. a G-step with all coefficients 1."""
    w = F.col("w")
    sums = cells.groupBy("feat_id").agg(F.sum(w).alias("sw"), F.sum(w * F.col("y")).alias("swy"), F.count_if(w > 0).alias("n_valid"))
    return sums.select("feat_id", F.array(F.try_divide("swy", "sw")).alias("g"), "n_valid").filter("n_valid > 0")


def gradients(cells: DataFrame, coeffs: DataFrame, basis: DataFrame, loss: Loss, k: int) -> tuple[DataFrame, DataFrame]:
    """Gradient of the loss: (obj_id, da) and (feat_id, dg)."""
    joined = with_coeffs(with_basis(cells, basis), coeffs)
    r = F.col("y") - dot(F.col("a"), F.col("g"), k)
    pull = joined.withColumn("p", F.lit(-2.0) * loss.total_weight(F.col("w"), r) * r)

    def total(key: str, vec: str, out: str) -> DataFrame:
        sums = [F.sum(F.col("p") * F.col(vec)[i]) for i in range(k)]
        return pull.groupBy(key).agg(F.array(*sums).alias(out))

    return total("obj_id", "g", "da"), total("feat_id", "a", "dg")


def total_loss(cells: DataFrame, loss: Loss, keys: tuple[str, ...] = ()) -> DataFrame:
    return cells.groupBy(*keys).agg(F.sum(loss.loss(F.col("w"), F.col("r"))).alias("loss"))


def gram(df: DataFrame, vec: str, k: int) -> DataFrame:
    """Gram matrix of a K-vector column, long form (k, l, value) with k <= l: one matrix a task, then their sum."""
    up = np.triu_indices(k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                x = kernels.matrix(batch.column(0))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(up[0], pa.int32()), pa.array(up[1], pa.int32()), pa.array(total[up])], names=["k", "l", "value"])

    rows = df.select(F.slice(F.col(vec), 1, k).cast("array<double>").alias("v")).where(F.size("v") == k)
    return arrow_map(rows, partial, "k int, l int, value double").groupBy("k", "l").agg(F.sum("value").alias("value"))


def max_frac_change(old: DataFrame, new: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """Largest squared change over the mean square of the new matrix: the convergence measure."""
    pair = old.select(key, F.col(vec).alias("o")).join(new.select(key, F.col(vec).alias("n")), key)
    step = F.greatest(*[F.pow(F.col("o")[i] - F.col("n")[i], 2) for i in range(k)], F.lit(0.0))
    size = sum((F.col("n")[i] * F.col("n")[i] for i in range(1, k)), F.col("n")[0] * F.col("n")[0])
    return pair.agg((F.max(step) / (F.avg(size) / k)).alias("max_frac"))


def object_scores(cells: DataFrame, scores: dict, weight: str = "w_rob", missing: str = "count") -> DataFrame:
    """Per-object scores. ``missing="count"`` lets missing cells (robust weight 1) take part."""
    if missing not in ("count", "skip"):
        raise ValueError(f"missing must be 'count' or 'skip', got {missing!r}")
    kept = cells if missing == "count" else cells.filter(F.col("w") > 0)
    aggs = [f(F.col(weight)).alias(name) for name, f in scores.items()]
    return kept.groupBy("obj_id").agg(*aggs, F.count_if(F.col("w") > 0).alias("n_valid"))
