import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import Cauchy, Gaussian, StudentT


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(0, 3, 200), rng.normal(0, 4, 200))]
    rows += [(1.0, 1e6), (0.0, 5.0), (2.0, 0.0)]
    return rows, spark.createDataFrame(rows, "w double, r double")


@pytest.mark.parametrize("loss", [Gaussian(), Cauchy(2.0), StudentT(4.0, 1.5)])
def test_columns_equal_numpy(cells, loss):
    rows, df = cells
    w, r = np.array(rows).T
    got = df.select(loss.weight(F.col("w"), F.col("r")).alias("a"), loss.loss(F.col("w"), F.col("r")).alias("b"), loss.total_weight(F.col("w"), F.col("r")).alias("c")).toPandas()
    np.testing.assert_allclose(got["a"], loss.weight_np(w, r), rtol=1e-12)
    np.testing.assert_allclose(got["b"], loss.loss_np(w, r), rtol=1e-12)
    np.testing.assert_allclose(got["c"], w * loss.weight_np(w, r), rtol=1e-12)


def test_families_agree_in_their_limits(cells):
    w, r = np.array(cells[0][:200]).T
    np.testing.assert_allclose(StudentT(1.0, 2.0).weight_np(w, r), Cauchy(2.0).weight_np(w, r))
    np.testing.assert_allclose(StudentT(1e9, 1.0).weight_np(w, r), 1.0, atol=1e-6)
    np.testing.assert_allclose(StudentT(1e9, 1.0).loss_np(w, r).sum(), Gaussian().loss_np(w, r).sum(), rtol=1e-6)


def test_weights_are_bounded_and_monotone(cells):
    w, r = np.array(cells[0]).T
    v = Cauchy(1.0).weight_np(w, r)
    assert np.isfinite(v).all() and (v > 0).all() and (v <= 1).all()
    assert Cauchy(1.0).weight_np(1.0, 50.0) < 1e-3
    assert (Cauchy(2.0).weight_np(w, r) >= v).all()


def test_loss_slope_is_that_of_weighted_least_squares():
    w, r, h = 1.7, 2.3, 1e-6
    for loss in (Cauchy(1.5), StudentT(3.0, 0.7)):
        slope = (loss.loss_np(w, r + h) - loss.loss_np(w, r - h)) / (2 * h)
        assert slope == pytest.approx(2 * w * loss.weight_np(w, r) * r, rel=1e-6)


@pytest.mark.parametrize("bad", [{"scale": 0.0}, {"scale": -1.0}, {"nu": 0.0}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        StudentT(**bad)
