"""Grids of models over population bins: fit, validate, choose, score and flag, all bins at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import kernels
from plumbline.functions.losses import Cauchy
from plumbline.functions.scores import ARRAY_SCORES
from plumbline.operators import bins as pop, metrics
from plumbline.plans.fit import FittedModel, ModelSpec, Settings, fit_many
from plumbline.plans.passes import blocks
from plumbline.plans.validate import calibrate, of_bins, waves
from plumbline.runtime import arrow_map, checkpointed, laid_out, pin_small
from plumbline.sources.store import ModelStore, ResultStore

# A list of bins longer than this is no list of populations.
MAX_BINS = 10_000
KEYS = ["bin", "obj_id"]


def model_name(bin: int, k: int, q: float) -> str:
    # six digits where they tell the scale, all of them where they don't
    scale = f"{q:g}" if float(f"{q:g}") == q else repr(q)
    return f"bin{bin:02d}_k{k}_q{scale}"


def grid_specs(bins: list[int], ks: list[int], qs: list[float]) -> list[ModelSpec]:
    return [ModelSpec(model_name(b, k, q), k, Cauchy(q), b) for b in bins for k in ks for q in qs]


def bin_list(members: DataFrame) -> list[int]:
    found = members.select("bin").distinct().limit(MAX_BINS + 1).collect()
    if len(found) > MAX_BINS:
        raise ValueError(f"more than {MAX_BINS} bins")
    return sorted(r["bin"] for r in found)


def fit_grid(train: DataFrame, ks: list[int], qs: list[float], settings: Settings = Settings(), store: ModelStore | None = None, buckets: int | None = None, ready: bool = False) -> dict[str, FittedModel]:
    """A model for every bin, rank and scale on ``train(bin, obj_id, y, w)``.

    The whole grid shares each pass over the data. With a store, models it already holds are
    loaded instead, and new ones are added to it. Rows that are ``ready`` are bucketed by bin and
    object and are not copied.
    """
    specs = grid_specs(bin_list(train), ks, qs)
    done: dict[str, FittedModel] = {}
    todo = specs
    if store is not None:
        wanted = train.sparkSession.createDataFrame([(s.model_id,) for s in specs], "model_id string")
        open_ids = {r["model_id"] for r in store.missing(wanted).collect()}
        done = {s.model_id: store.load(s.model_id) for s in specs if s.model_id not in open_ids}
        todo = [s for s in specs if s.model_id in open_ids]
    rows = train.select(F.col("bin").cast("int").alias("grp"), "obj_id", "y", "w")
    if done and todo:
        rows = rows.filter(F.col("grp").isin(sorted({s.grp for s in todo})))
    new = fit_many(rows, todo, settings, buckets=buckets, ready=ready)
    if store is not None:
        store.save_many(list(new.values()))
    return {s.model_id: done.get(s.model_id) or new[s.model_id] for s in specs}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def infer_many(objects: DataFrame, models: list[FittedModel], max_iter: int = 1000, tol: float = 1e-4, check_every: int = 5) -> DataFrame:
    """(model_id, bin, obj_id, a): every object of ``objects(bin, obj_id, y, w)`` under every model of its bin.

    Narrow; one pass for all models of a wave.
    """
    sc = objects.sparkSession.sparkContext

    def wave(ms: list[FittedModel]) -> DataFrame:
        told = sc.broadcast([(m.model_id, m.spec.grp, m.g, m.loss, m.ridge) for m in ms])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch, len(told.value[0][2])):
                    b = block.column("bin").to_numpy()
                    y, w = kernels.matrix(block.column("y")), kernels.matrix(block.column("w"))
                    ids = block.column("obj_id").to_numpy()
                    for name, grp, g, loss, ridge in told.value:
                        rows = b == grp
                        if not rows.any():
                            continue
                        a, _ = kernels.irls(y[rows], w[rows], g, loss, ridge, max_iter, tol, check_every)
                        n = int(rows.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * n), pa.array(b[rows].astype(np.int32)), pa.array(ids[rows]), kernels.lists(a)],
                            names=["model_id", "bin", "obj_id", "a"],
                        )

        rows = of_bins(objects, ms, models).select(F.col("bin").cast("int").alias("bin"), F.col("obj_id").cast("bigint").alias("obj_id"), "y", "w")
        return arrow_map(rows, run, "model_id string, bin int, obj_id bigint, a array<double>")

    return _union([wave(ms) for ms in waves(models)])


def apply_many(objects: DataFrame, coeffs: DataFrame, models: list[FittedModel]) -> DataFrame:
    """(model_id, bin, obj_id, y, w, pred, r, w_rob) from the output of ``infer_many``.

    Where both tables are laid out by (bin, obj_id) the join shuffles nothing.
    """
    sc = objects.sparkSession.sparkContext
    joined = coeffs.hint("shuffle_hash").join(objects.select("bin", "obj_id", "y", "w"), ["bin", "obj_id"]).select("model_id", "bin", "obj_id", "y", "w", "a")

    def wave(ms: list[FittedModel]) -> DataFrame:
        told = sc.broadcast({m.model_id: (m.g, m.loss) for m in ms})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column("model_id").dictionary_encode()
                of = names.indices.to_numpy()
                for i, name in enumerate(names.dictionary.to_pylist()):
                    g, loss = told.value[name]
                    mine = batch.take(pa.array(np.flatnonzero(of == i)))
                    for block in blocks(mine, len(g)):
                        y, w = kernels.matrix(block.column("y")), kernels.matrix(block.column("w"))
                        pred = kernels.matrix(block.column("a")) @ g.T
                        r = y - pred
                        yield pa.RecordBatch.from_arrays(
                            block.columns[:5] + [kernels.lists(x) for x in (pred, r, loss.weight_np(w, r))],
                            names=["model_id", "bin", "obj_id", "y", "w", "pred", "r", "w_rob"],
                        )

        mine = joined if len(ms) == len(models) else joined.filter(F.col("model_id").isin([m.model_id for m in ms]))
        return arrow_map(
            mine,
            run,
            "model_id string, bin int, obj_id bigint, y array<double>, w array<double>, pred array<double>, r array<double>, w_rob array<double>",
        )

    return _union([wave(ms) for ms in waves(models)])


def cross_validate(test: DataFrame, models: list[FittedModel], missing: str = "count", **options) -> DataFrame:
    """(bin, k, q, metric, value) of every model on held-out objects."""
    wide = calibrate(test, models, missing, **options)
    spark = test.sparkSession
    names = spark.createDataFrame([(m.model_id, m.spec.grp, m.k, float(m.loss.q2) ** 0.5) for m in models], "model_id string, bin int, k int, q double")
    return metrics.long_scores(wide.join(pin_small(names), "model_id"), ("bin", "k", "q"), metrics.METRICS)


@dataclass
class Population:
    """What a run over all bins leaves; every table is keyed by bin and object. ``scored`` has the arrays of flagged objects only."""

    members: DataFrame
    cv: DataFrame
    best: DataFrame
    models: dict[str, FittedModel]
    scored: DataFrame
    outliers: DataFrame
    summary: DataFrame


def analyse(
    members: DataFrame,
    objects: DataFrame,
    ks: list[int],
    qs: list[float],
    train_fraction: float = 0.5,
    seed: int = 42,
    metric: str = "std_z",
    threshold: float = 0.5,
    score: Column | str = "p01",
    settings: Settings = Settings(tol=1e-4, check_every=5),
    models: ModelStore | None = None,
    results: ResultStore | None = None,
    max_iter: int = 1000,
) -> Population:
    """Split every bin, fit the grid on one part, validate on the other, score all with the best model.

    ``members(bin, obj_id)`` may list an object in several bins; ``objects(obj_id, y, w)`` holds
    it once. With a result store all per-bin tables are written under the metric's name.
    """
    split = checkpointed(pop.split_train(members.select("bin", "obj_id"), train_fraction, seed))
    # the one shuffle of the wide rows: everything after it works on this layout
    data = laid_out(split.join(objects.select("obj_id", "y", "w"), "obj_id").withColumn("bin", F.col("bin").cast("int")), KEYS)
    fitted = fit_grid(data.filter("in_train"), ks, qs, settings, models, ready=True)
    options = {"max_iter": max_iter, "tol": 1e-4, "check_every": 5}
    cv = checkpointed(cross_validate(data.filter("NOT in_train"), list(fitted.values()), **options))
    best = metrics.best_models(cv).filter(F.col("metric") == metric).drop("value", "deviation")
    chosen_rows = best.collect()
    chosen = [fitted[model_name(r["bin"], r["best_k"], r["best_q"])] for r in chosen_rows]
    coeffs = laid_out(infer_many(data, chosen, **options), KEYS)
    if models is not None:
        models.save_many(
            [FittedModel(m.spark, ModelSpec(f"{m.model_id}/all", m.k, m.loss, m.spec.grp), m.g) for m in chosen],
            coeffs.select(F.concat("model_id", F.lit("/all")).alias("model_id"), "obj_id", "a"),
        )
    value = ARRAY_SCORES[score](F.col("w_rob")) if isinstance(score, str) else score
    # one evaluation: every score is kept, and the arrays of the flagged objects
    rows = apply_many(data, coeffs, chosen).withColumn("score", value)
    kept = [F.when(F.col("score") < threshold, F.col(c)).alias(c) for c in ("y", "w", "pred", "r", "w_rob")]
    scored = checkpointed(rows.select("model_id", "bin", "obj_id", "score", *kept))
    best = pin_small(best)
    flagged = scored.filter(F.col("score") < threshold).select("bin", "obj_id", "score")
    outliers = flagged.join(best.drop("metric"), "bin").join(split, ["bin", "obj_id"])
    counts = pop.outlier_fraction(scored.select("bin", "score"), threshold)
    summary = counts.join(best, "bin").withColumn("threshold", F.lit(float(threshold))).drop("fraction")
    if results is not None:
        results.write("object_scores", scored.select("bin", "obj_id", "score", F.lit(metric).alias("metric")))
        results.write("bin_summary", summary)
        results.write("outliers", outliers.withColumn("metric", F.lit(metric)))
        vectors = scored.filter(F.col("score") < threshold)
        results.write("outlier_vectors", vectors.select("bin", "obj_id", "score", "y", "pred", "w_rob", F.lit(metric).alias("metric")))
        results.write("residuals", vectors.select("bin", "obj_id", "r", F.lit(metric).alias("metric")))
    return Population(split, cv, best, fitted, scored, outliers, summary)
