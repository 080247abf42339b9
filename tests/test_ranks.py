import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ranks
from plumbline.operators.ranks import numbered, quantiles

PROBS = {"p01": 0.01, "p16": 0.16, "mid": 0.5, "p84": 0.84, "top": 1.0}


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(0)
    hot = np.concatenate([rng.normal(size=900), np.full(700, 0.25), rng.standard_cauchy(300) * 1e6])
    frames = [pd.DataFrame({"g": "hot", "v": hot}), pd.DataFrame({"g": "flat", "v": np.full(500, 3.0)}), pd.DataFrame({"g": "cold", "v": rng.normal(size=30)})]
    return pd.concat(frames).sample(frac=1, random_state=1)


@pytest.mark.parametrize("hot_rows", [10, 200, 10**6])
def test_grouped_quantiles(spark, values, hot_rows):
    df = spark.createDataFrame(values)
    got = quantiles(df, "v", PROBS, ("g",), hot_rows=hot_rows).toPandas().set_index("g")
    assert sorted(got.index) == ["cold", "flat", "hot"]
    for g, part in values.groupby("g"):
        np.testing.assert_allclose(got.loc[g, list(PROBS)].astype(float), np.quantile(part["v"], list(PROBS.values())), rtol=1e-12)


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_quantiles_of_a_whole_table(spark, values, hot_rows):
    df = spark.createDataFrame(values).unionByName(spark.createDataFrame([("x", None)], "g string, v double"))
    got = quantiles(df, "v", PROBS, hot_rows=hot_rows).first()
    np.testing.assert_allclose([got[n] for n in PROBS], np.quantile(values["v"], list(PROBS.values())), rtol=1e-12)


def test_numbered_spreads_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(0)).alias("g"), ((F.col("id") * 7919) % 5000).alias("x"))
    got = numbered(df, ["x"], ("g",)).toPandas()
    want = df.toPandas().sort_values(["g", "x"])
    want["row_no"] = want.groupby("g").cumcount()
    pd.testing.assert_frame_equal(
        got.sort_values(["g", "x"]).reset_index(drop=True)[["g", "x", "row_no"]], want.reset_index(drop=True)[["g", "x", "row_no"]], check_dtype=False
    )
    whole = numbered(df.select("x"), ["x"]).toPandas().sort_values("x")
    assert (whole["row_no"].to_numpy() == np.arange(5000)).all()


@pytest.mark.parametrize("odd", [[np.nan], [np.inf], [-np.inf, np.inf], [1e308, -1e308], [5e-324, -5e-324, 0.0, -0.0], [np.nan, np.inf, -np.inf, 1e308]])
def test_large_groups_answer_like_small_ones(spark, odd):
    values = list(np.random.default_rng(3).normal(size=300).round(1)) + odd
    rows = [(g, float(v)) for g in ("a", None) for v in values] + [("b", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probs = {"low": 0.0, "mid": 0.5, "p90": 0.9, "p997": 0.997, "top": 1.0}
    for by in ((), ("g",)):
        small, large = (sorted(map(repr, quantiles(df, "v", probs, by, hot_rows=n).collect())) for n in (10**6, 10))
        assert small == large


def test_only_values_near_a_rank_are_counted(spark, monkeypatch):
    seen, counts = [], ranks._by_counts
    monkeypatch.setattr(ranks, "_by_counts", lambda df, *rest: seen.append(df.count()) or counts(df, *rest))
    values = np.random.default_rng(5).normal(size=40_000)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": values}))
    got = quantiles(df, "v", {"mid": 0.5, "p90": 0.9}, ("g",), hot_rows=10).first()
    np.testing.assert_allclose([got["mid"], got["p90"]], np.quantile(values, [0.5, 0.9]), rtol=1e-12)
    assert len(seen) == 1 and seen[0] < 1_000


def test_numbered_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, x int")
    assert sorted(map(repr, map(tuple, numbered(df, ["x"], ("g",)).collect()))) == ["('a', 3, 0)", "(None, 1, 0)", "(None, 2, 1)"]
