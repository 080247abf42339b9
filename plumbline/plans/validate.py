"""Calibration of many models on held-out objects, without their cells ever leaving the map.

The map that infers the coefficients adds up what the metrics need while it has the cells in hand: counts, means, squared
deviations, and for the median of |z| a histogram over the leading bits of its 64-bit pattern, which for numbers from 0 on
sort like the numbers themselves. Two further maps, which only multiply, count the next bits within the leading
ones that hold the middle ranks, and at last the values that share nearly half of their bits with it. So a task sends a few hundred
rows a model whatever its number of cells, and the median is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions import kernels
from plumbline.plans.passes import blocks
from plumbline.runtime import BROADCAST_BYTES, arrow_map, checkpointed, laid_out, pin_small

KEYS = ["bin", "obj_id"]
#: Leading bits of the first histogram, and the bits the second adds to them.
FIRST, SECOND = 16, 12
_SUMS = -1
_FOUND = pa.schema(
    [("model_id", pa.string()), ("bin", pa.int32()), ("obj_id", pa.int64()), ("a", pa.list_(pa.float64())), ("code", pa.int64()),
     ("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64()), ("chi2", pa.float64())]
)
_FOUND_DDL = "model_id string, bin int, obj_id bigint, a array<double>, code bigint, n bigint, mean double, m2 double, chi2 double"


def waves(models: list) -> list[list]:
    """Models, those of a bin side by side, whose bases together stay within what may be sent to every task."""
    out: list[list] = [[]]
    size = 0
    for m in sorted(models, key=lambda m: m.spec.grp):
        if out[-1] and size + m.g.nbytes > BROADCAST_BYTES:
            out.append([])
            size = 0
        out[-1].append(m)
        size += m.g.nbytes
    return out


def of_bins(rows: DataFrame, models: list, all_models: list) -> DataFrame:
    """The rows that a wave has models for."""
    bins = {m.spec.grp for m in models}
    return rows if bins == {m.spec.grp for m in all_models} else rows.filter(F.col("bin").isin(sorted(bins)))


class _Sums:
    """Count, mean and squared deviations of z, sum of w r r, and the histogram of |z| of one model in one task."""

    def __init__(self):
        self.n, self.mean, self.m2, self.chi2 = 0, 0.0, 0.0, 0.0
        self.counts = np.zeros(1 << (FIRST - 1), np.int64)

    def add(self, z: np.ndarray, chi2: float) -> None:
        if not z.size:
            return
        mean = z.mean()
        d, n = mean - self.mean, self.n + z.size
        self.m2 += ((z - mean) ** 2).sum() + d * d * self.n * z.size / n
        self.mean += d * z.size / n
        self.n, self.chi2 = n, self.chi2 + chi2
        self.counts += np.bincount(_bits(z) >> (64 - FIRST), minlength=len(self.counts))


def _bits(z: np.ndarray) -> np.ndarray:
    """|z| as whole numbers in the same order; every NaN is the same largest one."""
    z = np.where(np.isnan(z), np.nan, np.abs(z))
    return z.view(np.int64)


def _deviations(y, w, a, g, loss, missing: str):
    """z of the cells that count, and their sum of w r r."""
    r = y - a @ g.T
    z = r * np.sqrt(w) * np.sqrt(loss.weight_np(w, r))
    square = w * r * r
    if missing == "skip":
        used = w > 0
        return z[used], square[used].sum()
    return z.ravel(), square.sum()


def _infer_and_sum(objects: DataFrame, models: list, missing: str, max_iter: int, tol: float, check_every: int) -> DataFrame:
    """Coefficients of every object under every model of its bin, and each task's sums as rows with a code."""
    sc = objects.sparkSession.sparkContext

    def wave(ms):
        told = sc.broadcast([(m.model_id, m.spec.grp, m.g, m.loss, m.ridge) for m in ms])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, _Sums] = {}
            of = {}
            for batch in batches:
                for block in blocks(batch, len(told.value[0][2])):
                    b = block.column("bin").to_numpy()
                    y, w = kernels.matrix(block.column("y")), kernels.matrix(block.column("w"))
                    for name, grp, g, loss, ridge in told.value:
                        rows = np.flatnonzero(b == grp)
                        if not len(rows):
                            continue
                        yr, wr = y[rows], w[rows]
                        a, _ = kernels.irls(yr, wr, g, loss, ridge, max_iter, tol, check_every)
                        sums.setdefault(name, _Sums()).add(*_deviations(yr, wr, a, g, loss, missing))
                        of[name] = grp
                        n = len(rows)
                        none, no = pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())
                        names = pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [name]).dictionary_decode()
                        yield pa.RecordBatch.from_arrays([names, pa.array(np.full(n, grp, np.int32)), block.column("obj_id").take(pa.array(rows)), kernels.lists(a), none, none, no, no, no], schema=_FOUND)
            # the sums are dealt to the buckets by the number of the task
            place = TaskContext.get().partitionId()
            for name, s in sums.items():
                codes = np.flatnonzero(s.counts)
                n, zero = len(codes) + 1, [0.0] * len(codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(np.full(n, of[name], np.int32)), pa.array(np.full(n, place, np.int64)), pa.nulls(n, pa.list_(pa.float64())),
                     pa.array(np.append(codes, _SUMS)), pa.array(np.append(s.counts[codes], s.n)), *[pa.array([*zero, float(x)]) for x in (s.mean, s.m2, s.chi2)]], schema=_FOUND)

        rows = of_bins(objects, ms, models).select(F.col("bin").cast("int").alias("bin"), F.col("obj_id").cast("bigint").alias("obj_id"), "y", "w")
        return arrow_map(rows, run, _FOUND_DDL)

    parts = [wave(ms) for ms in waves(models)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _count_within(joined: DataFrame, models: list, wanted: dict[str, list[int]], missing: str, known: int, more: int) -> DataFrame:
    """(model_id, code, n, value): how many cells share the first ``known`` bits with a wanted code, by the first ``known + more``."""
    sc = joined.sparkSession.sparkContext

    def wave(ms):
        told = sc.broadcast({m.model_id: (m.g, m.loss, np.unique(wanted[m.model_id])) for m in ms if m.model_id in wanted})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                names = batch.column("model_id").dictionary_encode()
                of = names.indices.to_numpy()
                for i, name in enumerate(names.dictionary.to_pylist()):
                    if name not in told.value:
                        continue
                    g, loss, codes = told.value[name]
                    for block in blocks(batch.take(pa.array(np.flatnonzero(of == i))), len(g)):
                        y, w, a = (kernels.matrix(block.column(c)) for c in ("y", "w", "a"))
                        bits = _bits(_deviations(y, w, a, g, loss, missing)[0])
                        bits = bits[np.isin(bits >> (64 - known), codes)] >> (64 - known - more)
                        code, n = np.unique(bits, return_counts=True)
                        if name in held:
                            both = np.concatenate([held[name][0], code])
                            code, at = np.unique(both, return_inverse=True)
                            n = np.bincount(at, np.concatenate([held[name][1], n]), len(code)).astype(np.int64)
                        held[name] = code, n
            for name, (code, n) in held.items():
                value = code.view(np.float64) if known + more == 64 else np.zeros(len(code))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code), pa.array(n), pa.array(value)], names=["model_id", "code", "n", "value"])

        return arrow_map(of_bins(joined, ms, models), run, "model_id string, code bigint, n bigint, value double")

    parts = [wave(ms) for ms in waves(models)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("model_id", "code").agg(F.sum("n").alias("n"), F.max("value").alias("value"))


def _narrow(counts: DataFrame, wanted: DataFrame, shift: int) -> DataFrame:
    """(model_id, which, code, rank, value): the code in which a wanted rank of its parent lies, and its rank there.

    A parent has few codes: those its bits leave, or the distinct values that share most of their bits.
    """
    rows = counts.withColumn("parent", F.shiftright("code", shift) if shift else F.lit(0).cast("bigint"))
    upto = F.sum("n").over(Window.partitionBy("model_id", "parent").orderBy("code"))
    rows = rows.withColumn("before", upto - F.col("n")).withColumnRenamed("n", "own")
    held = rows.join(wanted.select("model_id", "which", F.col("code").alias("parent"), "rank"), ["model_id", "parent"])
    return held.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("own"))).select(
        "model_id", "which", "code", (F.col("rank") - F.col("before")).alias("rank"), "value")


def _told(places: DataFrame) -> dict[str, list[int]]:
    """Two codes a model at most; the driver holds the models anyway."""
    out: dict[str, list[int]] = {}
    for r in places.select("model_id", "code").collect():
        out.setdefault(r["model_id"], []).append(r["code"])
    return out


def calibrate(objects: DataFrame, models: list, missing: str = "count", max_iter: int = 1000, tol: float = 1e-4, check_every: int = 5) -> DataFrame:
    """(model_id, std_z, chi2_red, rmse, kl, mad_z) of every model on ``objects(bin, obj_id, y, w)`` of its bin.

    The same numbers as ``metrics.calibration`` gives on the cells. NaN is larger than any number in the median and makes
    the other metrics NaN. A model without held-out cells has no row.
    """
    if missing not in ("count", "skip"):
        raise ValueError(f"missing must be 'count' or 'skip', got {missing!r}")
    found = laid_out(_infer_and_sum(objects, models, missing, max_iter, tol, check_every), KEYS)
    coeffs = found.where("code IS NULL").select("model_id", "bin", "obj_id", "a")
    joined = coeffs.hint("shuffle_hash").join(objects.select("bin", "obj_id", "y", "w"), KEYS).select("model_id", "bin", "y", "w", "a")

    parts = found.where(F.col("code") == _SUMS).select("model_id", "n", "mean", "m2", "chi2")
    total = parts.groupBy("model_id").agg(F.sum("n").alias("cells"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mu"))
    around = parts.join(total, "model_id").groupBy("model_id", "cells", "mu").agg(
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("mu")) * (F.col("mean") - F.col("mu"))).alias("m2"), F.sum("chi2").alias("chi2"))
    total = checkpointed(around)

    both = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.expr("(cells - 1) div 2").alias("rank")), F.struct(F.lit(1).alias("which"), F.expr("cells div 2").alias("rank"))))
    wanted = total.where("cells > 0").select("model_id", both.alias("w")).select("model_id", "w.which", "w.rank", F.lit(0).cast("bigint").alias("code"))
    counts = found.where(F.col("code") >= 0).groupBy("model_id", "code").agg(F.sum("n").alias("n")).withColumn("value", F.lit(0.0))
    first = checkpointed(_narrow(counts, wanted, 0))
    second = checkpointed(_narrow(_count_within(joined, models, _told(first), missing, FIRST, SECOND), first, SECOND))
    known = FIRST + SECOND
    last = _narrow(_count_within(joined, models, _told(second), missing, known, 64 - known), second, 64 - known)
    ends = last.groupBy("model_id").agg(*[F.max(F.when(F.col("which") == i, F.col("value"))).alias(n) for i, n in enumerate(("lo", "hi"))])
    middle = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(0.5 * F.col("lo") + 0.5 * F.col("hi"))

    n, mu = F.col("cells"), F.col("mu")
    std, chi2 = F.sqrt(F.col("m2") / n), F.col("chi2") / n
    kl = F.when(std > 0, -F.log(std) + (std * std + mu * mu) / 2 - F.lit(0.5))
    metrics = total.where("cells > 0").select("model_id", std.alias("std_z"), chi2.alias("chi2_red"), F.sqrt(chi2).alias("rmse"), kl.alias("kl"))
    return metrics.join(pin_small(ends.select("model_id", middle.alias("mad_z"))), "model_id")
