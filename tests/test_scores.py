import numpy as np
import pytest
from pyspark.sql import functions as F

from problems import arrays
from plumbline import Cauchy, ModelSpec
from plumbline.functions.scores import ARRAY_SCORES, CELL_SCORES, MATRIX_SCORES
from plumbline.plans.fit import FittedModel
from plumbline.plans.score import infer_and_apply


@pytest.fixture(scope="module")
def model(spark, problem):
    return FittedModel(spark, ModelSpec("m", 3, Cauchy(2.0)), problem.g + 0.05)


@pytest.mark.parametrize("missing", ["count", "skip"])
def test_every_score_in_its_three_forms(spark, problem, model, missing):
    df = problem.frame(spark)
    names = tuple(ARRAY_SCORES)
    assert set(names) == set(CELL_SCORES) == set(MATRIX_SCORES)
    fast = model.score(df, scores=names, missing=missing, n_steps=4).orderBy("obj_id").toPandas()
    own = model.score(df, scores=dict(ARRAY_SCORES), missing=missing, n_steps=4).orderBy("obj_id").toPandas()
    rows = infer_and_apply(df, model, n_steps=4)
    cells = rows.select("obj_id", F.explode(F.arrays_zip("w", "w_rob")).alias("c")).select("obj_id", "c.w", "c.w_rob")
    if missing == "skip":
        cells = cells.filter("w > 0")
    agg = cells.groupBy("obj_id").agg(*[f(F.col("w_rob")).alias(n) for n, f in CELL_SCORES.items()]).orderBy("obj_id").toPandas()
    for n in names:
        np.testing.assert_allclose(fast[n], agg[n], rtol=1e-9, err_msg=n)
        np.testing.assert_allclose(own[n], agg[n], rtol=1e-9, err_msg=n)
    assert (fast["is_outlier"] == own["is_outlier"]).all()


def test_outputs_fit_together(spark, problem, model):
    df = problem.frame(spark).withColumn("tag", F.col("obj_id") % 3)
    rows = infer_and_apply(df, model, n_steps=3)
    np.testing.assert_allclose(arrays(rows, "pred"), arrays(rows, "a") @ model.g.T)
    np.testing.assert_allclose(arrays(rows, "r"), problem.y - arrays(rows, "pred"))
    assert model.infer(df).columns == ["obj_id", "tag", "a", "n_steps", "n_valid"]
    assert model.score(df).columns == ["obj_id", "tag", "n_valid", "n_steps", "p01", "is_outlier"]
    with pytest.raises(ValueError):
        model.score(df, scores=("p99",))
    with pytest.raises(ValueError):
        model.score(df, missing="drop")
