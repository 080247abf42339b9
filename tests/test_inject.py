import numpy as np
import pytest
from pyspark.sql import functions as F

from problems import Problem
from plumbline import Factorizer
from plumbline.functions import draws
from plumbline.operators import diagnose, inject, metrics, prepare

M = 40


@pytest.fixture(scope="module")
def cells(spark):
    p = Problem(n=200, m=M, missing=0.0, bad=0.0, seed=8)
    return prepare.objects_to_cells(p.frame(spark)).cache()


def test_draws_are_uniform_and_independent_of_layout(spark):
    u = np.array([r[0] for r in spark.range(20000).select(draws.uniform(1, F.col("id"))).collect()])
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.002 and len(np.unique(u)) == 20000
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.03
    v = np.array([r[0] for r in spark.range(20000).repartition(3).orderBy("id").select(draws.uniform(1, F.col("id"))).collect()])
    assert (u == v).all()


def frames(cells, out, labels):
    a = cells.toPandas().set_index(["obj_id", "feat_id"]).sort_index()
    b = out.toPandas().set_index(["obj_id", "feat_id"]).sort_index()
    lab = {(r["obj_id"], r["feat_id"]) for r in labels.collect()}
    assert list(a.index) == list(b.index)
    mask = np.array([i in lab for i in a.index])
    return a, b, mask


def test_only_labelled_cells_change(cells):
    for out, labels in (
        inject.sinusoids(cells, M, n=4),
        inject.spikes(cells, 0.02),
        inject.bad_columns(cells, M, n=3, fraction=0.3),
    ):
        a, b, mask = frames(cells, out, labels)
        changed = a["y"].to_numpy() != b["y"].to_numpy()
        assert mask.any() and (changed == mask).all() and (a["w"] == b["w"]).all()


def test_shapes_of_the_corruptions(cells):
    out, labels = inject.sinusoids(cells, M, n=4, amp=(0.05, 0.2))
    a, b, mask = frames(cells, out, labels)
    assert mask.sum() == 4 * M and (np.abs(b["y"][mask] - 1) <= 0.2).all()
    out, labels = inject.spikes(cells, 0.02)
    a, b, mask = frames(cells, out, labels)
    jump = np.abs(b["y"] - a["y"])[mask]
    assert 0.01 < mask.mean() < 0.03 and jump.min() >= 0.5 - 1e-9 and jump.max() <= 1 + 1e-9
    out, labels = inject.bad_columns(cells, M, n=3, fraction=0.3)
    per = labels.groupBy("feat_id").count().collect()
    assert len(per) == 3 and all(30 <= r["count"] <= 90 for r in per)
    out, labels = inject.dips(cells, M, n=6, lines=2, width=1.0)
    a, b, mask = frames(cells, out, labels)
    drop = (a["y"] - b["y"]).to_numpy()
    assert (drop >= -1e-12).all() and drop[mask].min() > 0.0005 and drop[~mask].max() < 0.01
    assert labels.select("obj_id").distinct().count() == 6


def test_missing_segments_keep_clear(cells):
    _, avoid = inject.spikes(cells, 0.05)
    out, labels = inject.missing_segments(cells, avoid, fraction=0.5, segments=2, min_length=3, max_length=6)
    a, b, mask = frames(cells, out, labels)
    assert labels.count() == labels.select("obj_id", "feat_id").distinct().count()
    assert labels.join(avoid, ["obj_id", "feat_id"]).isEmpty()
    assert (b["w"][mask] == 0).all() and (b["y"][mask] == 0).all() and (b["w"][~mask] > 0).all()
    n = labels.select("obj_id").distinct().count()
    assert 70 < n < 130
    per = labels.groupBy("obj_id").count().collect()
    assert all(3 <= r["count"] <= 12 for r in per) and max(r["count"] for r in per) > 6


def test_injected_spikes_are_found_again(cells):
    out, labels = inject.spikes(cells, 0.01, (3.0, 5.0), seed=3)
    objects = prepare.cells_to_objects(out, M)
    model = Factorizer(3, scale=5.0, tol=1e-5, check_every=5, max_iter=40).fit(objects)
    found = prepare.objects_to_cells(model.apply(), ("w_rob",))
    truth = labels.select("obj_id", "feat_id", F.lit(True).alias("t"))
    rows = found.join(truth, ["obj_id", "feat_id"], "left").withColumns({"t": F.coalesce("t", F.lit(False)), "p": F.col("w_rob") < 0.5})
    assert metrics.detection_f1(rows, "t", "p").first()["f1"] > 0.95


def test_f1_without_any_positives(spark):
    df = spark.createDataFrame([(False, False)] * 3, "t boolean, p boolean")
    r = metrics.detection_f1(df, "t", "p").first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"]) == (0, 0, 0, 0.0)


def test_histogram_edges(spark):
    v = np.array([0.0, 0.1, 0.25, 0.5, 0.999, 1.0, 1.0, 1.5, -0.1])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = diagnose.histogram(df, "v", 0.0, 1.0, 4).orderBy("cell").collect()
    want, _ = np.histogram(v, bins=np.linspace(0, 1, 5))
    dens, _ = np.histogram(v, bins=np.linspace(0, 1, 5), density=True)
    assert [r["n"] for r in got] == list(want)
    np.testing.assert_allclose([r["density"] for r in got], dens)


def test_a_large_draw_is_that_of_a_sort(spark):
    ids = spark.range(300_000).select(F.col("id").alias("obj_id"))
    for n in (0, 1, 100_000, 299_999, 300_000, 400_000):
        got = inject.pick_objects(ids.unionAll(ids), n, 4)
        want = ids.withColumn("u", draws.uniform(4, F.col("obj_id"))).orderBy("u", "obj_id").limit(n).select("obj_id")
        assert got.count() == min(n, 300_000) and got.join(want, "obj_id", "left_anti").isEmpty()
    assert inject.pick_objects(ids.limit(0), 5, 4).isEmpty()
