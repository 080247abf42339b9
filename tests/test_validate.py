"""Calibration inside the inference map against the same metrics on its cells."""

import numpy as np
import pytest
from problems import Problem
from pyspark.sql import functions as F

from plumbline.functions import measure
from plumbline.functions.losses import Cauchy
from plumbline.operators import metrics
from plumbline.operators.prepare import objects_to_cells
from plumbline.plans import population, validate
from plumbline.plans.fit import FittedModel, ModelSpec


def _models(spark, g, bins):
    return [FittedModel(spark, ModelSpec(f"b{b}k{k}", k, Cauchy(q), b), g[:, :k].copy()) for b in bins for k, q in ((1, 2.0), (2, 3.0))]


def _on_cells(rows, models, missing):
    cells = objects_to_cells(population.apply_many(rows, population.infer_many(rows, models), models), ("w", "r", "w_rob"), ("model_id",))
    cells = cells.withColumn("z", measure.z_score(F.col("r"), F.col("w"), F.col("w_rob")))
    return {r["model_id"]: r for r in metrics.calibration(cells, ("model_id",), missing).collect()}


@pytest.mark.parametrize("missing", ["count", "skip"])
@pytest.mark.parametrize("small_waves", [False, True])
def test_same_numbers_as_on_cells(spark, monkeypatch, missing, small_waves):
    p = Problem(n=151, m=21, k=2, seed=2)
    rows = p.frame(spark).withColumn("bin", F.col("obj_id") % 2)
    models = _models(spark, p.g, (0, 1, 7))  # nothing is held out for bin 7
    if small_waves:
        monkeypatch.setattr(validate, "BROADCAST_BYTES", 1)
    got = {r["model_id"]: r for r in validate.calibrate(rows, models, missing).collect()}
    want = _on_cells(rows, models[:4], missing)
    assert set(got) == set(want) == {"b0k1", "b0k2", "b1k1", "b1k2"}
    for name, r in want.items():
        assert got[name]["mad_z"] == r["mad_z"]
        for m in ("std_z", "chi2_red", "rmse", "kl"):
            assert got[name][m] == pytest.approx(r[m], rel=1e-9)


def test_ties_and_no_number(spark):
    """Half of all cells are missing, so that the median of |z| is 0; a value that is none is the largest."""
    y = np.zeros((6, 4))
    y[:, 3] = np.arange(6)
    w = np.where(np.arange(4) == 3, 1.0, 0.0) * np.ones((6, 1))
    rows = spark.createDataFrame([(0, i, y[i].tolist(), w[i].tolist()) for i in range(6)], "bin int, obj_id bigint, y array<double>, w array<double>")
    g = np.array([[0.0], [0.0], [0.0], [1e-3]])
    model = FittedModel(spark, ModelSpec("m", 1, Cauchy(1.0), 0), g)
    got = validate.calibrate(rows, [model]).first()
    assert got["mad_z"] == 0.0
    assert validate.calibrate(rows.limit(0), [model]).count() == 0
    bits = validate._bits(np.array([-np.inf, 0.0, -0.0, 1.5, -1.5, np.nan, -np.nan]))
    assert bits[1] == bits[2] < bits[3] == bits[4] < bits[0] < bits[5] == bits[6]
