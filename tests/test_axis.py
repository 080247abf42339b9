import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import axis


def chunks(x, factor, step):
    x = np.sort(x)
    d = np.diff(np.unique(x))
    step = np.median(d) if step is None else step
    u = np.unique(x)
    cut = np.where(np.diff(u) > factor * step)[0] + 1
    return [(p[0], p[-1], int(np.isin(x, p).sum())) for p in np.split(u, cut)]


@pytest.mark.parametrize("width", [0.5, 7.0, 1e6])
@pytest.mark.parametrize("step", [None, 0.05])
def test_gap_chunks(spark, width, step):
    rng = np.random.default_rng(2)
    data = {u: np.round(np.concatenate([rng.uniform(0, 3, 40), rng.uniform(20, 22, 30), rng.uniform(5, 6, 5), [5.5, 5.5]]), 3) for u in range(4)}
    data[9] = np.array([1.0])
    df = spark.createDataFrame([(u, float(v)) for u, xs in data.items() for v in xs], "u int, x double")
    got = axis.gap_chunks(df, "x", ("u",), width, 3.0, step).orderBy("u", "chunk").collect()
    for u, xs in data.items():
        want = chunks(xs, 3.0, step) if len(xs) > 1 else [(1.0, 1.0, 1)]
        assert [(r["x_start"], r["x_end"], r["n"]) for r in got if r["u"] == u] == want
        assert [r["chunk"] for r in got if r["u"] == u] == list(range(len(want)))


def greedy(rows, tol):
    kept = []
    for no, pos, x in sorted(rows):
        if not any(round(abs(x - k[2]), 9) < tol for k in kept):
            kept.append((no, pos, x))
    return set(kept)


@pytest.mark.parametrize("pieces, block", [(1, 1), (3, 2), (64, 64)])
@pytest.mark.parametrize("kind", ["random", "sorted", "ties"])
def test_dedupe_equals_one_by_one(spark, kind, pieces, block, monkeypatch):
    monkeypatch.setattr(axis, "PIECES", pieces)
    monkeypatch.setattr(axis, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(-2, 2, 120), 4) if kind != "ties" else rng.integers(0, 12, 120) / 8
    if kind == "sorted":
        x = np.sort(x)[:40]
    rows = [(int(i % 3) if kind != "sorted" else 0, i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "list_no int, pos int, x double")
    tol = 0.0713 if kind != "ties" else 0.125
    got = {(r["list_no"], r["pos"], r["x"]) for r in axis.dedupe_lines(df, tol).collect()}
    assert got == greedy(rows, tol)


@pytest.mark.parametrize("grid", [0.3, 5.0])
def test_match_ranges(spark, grid):
    rng = np.random.default_rng(6)
    seg = [(i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(rng.uniform(-5, 5, 60), rng.exponential(1, 60)))]
    lines = [(j, float(v)) for j, v in enumerate(rng.uniform(-5, 6, 40))]
    bands = [(j, float(v), float(v + 0.8)) for j, v in enumerate(rng.uniform(-5, 6, 40))]
    s = spark.createDataFrame(seg, "i int, seg_start double, seg_end double")
    got = axis.match_ranges(s, spark.createDataFrame(lines, "j int, x double"), grid, 0.1).select("i", "j").collect()
    want = sorted((i, j) for i, a, b in seg for j, v in lines if v + 0.1 >= a and v - 0.1 <= b)
    assert sorted(map(tuple, got)) == want
    got = axis.match_ranges(s, spark.createDataFrame(bands, "j int, x_start double, x_end double"), grid).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, a, b in seg for j, u, v in bands if v >= a and u <= b)


def test_match_ranges_in_crowded_cells(spark, monkeypatch):
    """Beyond the broadcast limit, with nearly all rows in one cell and half of them equal: the same matches, from even tiles."""
    monkeypatch.setattr(axis, "pin_small", lambda df: df)
    monkeypatch.setattr(axis, "TILE", 50)
    rng = np.random.default_rng(8)
    start = np.concatenate([rng.uniform(0, 0.9, 500), np.full(500, 0.5), rng.uniform(-30, 30, 20)])
    seg = [(i, float(a), float(a + 0.001 + (i % 7) * 0.01)) for i, a in enumerate(start)]
    lines = [(j, float(v)) for j, v in enumerate(np.concatenate([rng.uniform(0, 1, 300), rng.uniform(-30, 30, 40), [0.505] * 5]))]
    s, k = spark.createDataFrame(seg, "i int, seg_start double, seg_end double"), spark.createDataFrame(lines, "j int, x double")
    got = axis.match_ranges(s, k, 1.0).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, a, b in seg for j, v in lines if a <= v <= b)

    left, right = axis._dealt(s.withColumn("_g", F.lit(0)), k.withColumn("_g", F.lit(0)))
    for side, rows, lines_of in ((left, len(seg), 7), (right, len(lines), 21)):
        sizes = [r["count"] for r in side.groupBy("_a", "_b").count().collect()]
        assert len(sizes) == 21 * 7 and sum(sizes) == rows * lines_of and max(sizes) <= 2 * np.median(sizes)


def test_low_weight_runs(spark):
    w = [1, 1, 0.1, 0.1, 0.1, 1, 1, 1, 0.2, 1]
    df = spark.createDataFrame([(1, j, float(v)) for j, v in enumerate(w)], "obj_id int, feat_id int, w_rob double")
    got = axis.low_weight_runs(df, 1, 0.75).orderBy("run").collect()
    assert [(r["run"], r["feat_start"], r["feat_end"], r["n"]) for r in got] == [(0, 1, 5, 5), (1, 7, 9, 3)]
    assert got[0]["mean_weight"] == pytest.approx((1 + 0.3 + 1) / 5)
    assert df.filter(F.col("w_rob") < 0).isEmpty()
