import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import bins, crossbin, metrics
from plumbline.operators.ranks import quantiles
import plumbline.operators.bins as bins_module


@pytest.fixture(scope="module")
def stars(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.uniform(-0.4, 3.3, 1500), rng.normal(1.4, 0.01, 700)])
    y = np.concatenate([rng.uniform(-1, 14, 1500), rng.normal(6.8, 0.1, 700)])
    return x, y, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "obj_id bigint, x double, y double")


def brute(x, y, geo):
    cx = np.linspace(geo.x_min, geo.x_max, geo.n)
    cy = np.linspace(geo.y_min, geo.y_max, geo.n) + geo.bump_height * np.exp(-0.5 * ((cx - geo.bump_centre) / geo.bump_sigma) ** 2)
    return {(b, i) for b in range(geo.n) for i in np.where(((x - cx[b]) / (geo.x_width / 2)) ** 2 + ((y - cy[b]) / (geo.y_width / 2)) ** 2 < 1)[0]}


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("grid", [None, 0.05])
def test_membership_equals_brute_force(spark, stars, grid, small, monkeypatch):
    x, y, df = stars
    if not small:
        monkeypatch.setattr(bins_module, "pin_small", lambda d: d)
    geo = bins.BinGeometry()
    got = bins.bin_members(df, bins.bin_table(spark, geo), grid=grid).collect()
    assert len(got) == len({(r["bin"], r["obj_id"]) for r in got})
    assert {(r["bin"], r["obj_id"]) for r in got} == brute(x, y, geo)


def test_train_split_is_exact_and_stable(spark):
    df = spark.range(9000).select(F.when(F.col("id") < 8000, 0).otherwise(F.col("id") % 7 + 1).cast("int").alias("bin"), F.col("id").alias("obj_id"))
    for slices in (1, 16, 4096):
        split = bins.split_train(df, 0.37, 1, slices=slices)
        got = split.groupBy("bin").agg(F.count("*").alias("n"), F.count_if("in_train").alias("t")).collect()
        assert sum(r["n"] for r in got) == 9000 and all(r["t"] == int(r["n"] * 0.37) for r in got)
        ids = {(r["bin"], r["obj_id"]) for r in split.filter("in_train").collect()}
        if slices == 1:
            want = ids
        assert ids == want
    assert ids == {(r["bin"], r["obj_id"]) for r in bins.split_train(df.repartition(3), 0.37, 1).filter("in_train").collect()}
    assert bins.split_train(df, 1.0, 1).filter("NOT in_train").isEmpty()
    assert bins.split_train(df, 0.0, 1).filter("in_train").isEmpty()


def test_samples(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("int").alias("bin"), F.col("id").alias("obj_id"))
    s = bins.sample_per_group(df, 20, 3)
    assert [r["count"] for r in s.groupBy("bin").count().collect()] == [20, 20, 20]
    assert bins.sample_per_group(df, 10**6, 3).count() == 1000
    few, many = bins.sample_per_group(df, 20, 3), bins.sample_per_group(df, 200, 3)
    assert few.exceptAll(many).isEmpty()
    scores = df.withColumn("score", (F.col("obj_id") * 37 % 101) / 101.0)
    top = bins.extremes_per_group(scores, 7)
    wide = bins.extremes_per_group(scores, 1000)
    assert wide.count() == 1000 and sorted(map(tuple, top.collect())) == sorted(map(tuple, wide.filter("rank <= 7").select(*top.columns).collect()))
    sys = bins.systematic_sample(df, 50)
    by_bin = {b: sorted(r["obj_id"] for r in sys.collect() if r["bin"] == b) for b in range(3)}
    for b, ids in by_bin.items():
        mine = [i for i in range(1000) if i % 3 == b]
        assert ids == mine[:: len(mine) // 50]


def test_cross_bin_verdicts_against_sets(spark):
    rng = np.random.default_rng(7)
    member = {(int(b), int(o)) for b, o in zip(rng.integers(0, 4, 600), rng.integers(0, 250, 600))}
    score = {p: float(rng.uniform()) for p in member}
    flagged = {p for p, s in score.items() if s < 0.5}
    m = spark.createDataFrame([(b, o, score[b, o]) for b, o in member], "bin int, obj_id bigint, score double")
    out = m.filter("score < 0.5")
    of, on = {}, {}
    for b, o in member:
        of.setdefault(o, set()).add(b)
    for b, o in flagged:
        on.setdefault(o, set()).add(b)
    multi = [o for o in on if len(of[o]) > 1]
    r = crossbin.consistency(m, out).first()
    assert (r["n_outlier_objects"], r["n_multi"]) == (len(on), len(multi))
    assert r["n_all"] == sum(on[o] >= of[o] for o in multi) and r["n_some"] == sum(not on[o] >= of[o] for o in multi)
    bad = {o for o in multi if not on[o] >= of[o]}
    kept = {x["obj_id"] for x in crossbin.drop_inconsistent(out, m, out).collect()}
    assert kept == set(on) - bad
    dual = crossbin.dual_scores(m)
    assert {x["obj_id"] for x in dual.collect()} == {o for o in of if len(of[o]) == 2}
    one = crossbin.dual_summary(dual).filter("cls = 'one'").first()
    other = [max(score[b, o] for b in of[o]) for o in of if len(of[o]) == 2 and len(on.get(o, ())) == 1]
    assert one["n"] == len(other) and one["other_median"] == pytest.approx(np.median(other))


def test_best_models_ties_and_gaps(spark):
    rows = [(0, 1, 1.0, "std_z", 0.9), (0, 1, 2.0, "std_z", 1.1), (0, 2, 1.0, "std_z", float("nan")), (0, 2, 1.0, "rmse", 0.1), (0, 1, 1.0, "rmse", 0.2), (1, 3, 5.0, "std_z", 4.0)]
    df = spark.createDataFrame(rows, "bin int, k int, q double, metric string, value double").withColumn("value", F.round("value", 6))
    got = {(r["bin"], r["metric"]): (r["best_k"], r["best_q"]) for r in metrics.best_models(df).collect()}
    assert got[0, "rmse"] == (2, 1.0) and got[1, "std_z"] == (3, 5.0) and got[0, "std_z"][0] == 1


def test_calibration_narrowing_equals_numpy(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0.1, 1.3, 4000)
    df = spark.createDataFrame([(float(v), 1.0, float(v)) for v in z], "z double, w double, r double")
    got = metrics.calibration(df).first()
    assert got["mad_z"] == pytest.approx(np.median(np.abs(z))) and got["std_z"] == pytest.approx(z.std())
    assert got["kl"] == pytest.approx(-np.log(z.std()) + (z.std() ** 2 + z.mean() ** 2) / 2 - 0.5)
    hot = quantiles(df.withColumn("a", F.abs("z")), "a", {"m": 0.5}, hot_rows=50).first()["m"]
    assert hot == pytest.approx(np.median(np.abs(z)))
