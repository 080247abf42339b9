import numpy as np
import pytest
from pyspark.sql import functions as F

from problems import Problem, arrays
from plumbline import Cauchy, Factorizer, Gaussian, ModelSpec, fit_many
from plumbline.operators import cells as ops, prepare
from plumbline.plans import baselines, start
from plumbline.plans.optimisers import Momentum
from plumbline.plans.fit import Settings, frac_change
from plumbline.plans.passes import Passes
import twin

Q = 3.0


def product(model):
    return arrays(model.coeffs, "a") @ model.g.T


@pytest.fixture(scope="module")
def df(spark, problem):
    return problem.frame(spark).cache()


def test_fit_equals_the_twin(df, problem):
    model = Factorizer(3, scale=Q, conv="none", max_iter=4).fit(df)
    a, g, history = twin.fit(problem.y, problem.w, 3, Q * Q, 4)
    np.testing.assert_allclose(product(model), a @ g.T, atol=1e-7)
    np.testing.assert_allclose(model.loss_history, history, rtol=1e-9)
    assert model.n_iter == 4 and not model.converged
    # whitened, up to the small ridge
    np.testing.assert_allclose(model.g.T @ model.g, np.eye(3), atol=1e-4)


@pytest.mark.parametrize("options, extra", [({"loss": Gaussian()}, {"robust": False}), ({"scale": Q, "reweight": "each"}, {"each": True})])
def test_variants_equal_the_twin(df, problem, options, extra):
    model = Factorizer(3, conv="none", max_iter=3, **options).fit(df)
    a, g, history = twin.fit(problem.y, problem.w, 3, Q * Q, 3, **extra)
    np.testing.assert_allclose(product(model), a @ g.T, atol=1e-7)
    np.testing.assert_allclose(model.loss_history, history, rtol=1e-9)


def test_buckets_do_not_matter_and_the_loss_never_rises(df):
    fits = [Factorizer(3, scale=Q, conv="none", max_iter=5).fit(df, buckets=b) for b in (1, 7)]
    np.testing.assert_allclose(product(fits[0]), product(fits[1]), atol=1e-9)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(fits[0].loss_history, fits[0].loss_history[1:]))


@pytest.mark.parametrize("kw", [{"target": "A"}, {"whiten": False}, {"rotation": "slow"}, {"rotation": "identity"}, {"order": True}])
def test_rotation_leaves_the_product(df, problem, kw):
    model = Factorizer(3, scale=Q, conv="none", max_iter=3, **kw).fit(df)
    a, g, _ = twin.fit(problem.y, problem.w, 3, Q * Q, 3)
    np.testing.assert_allclose(product(model), a @ g.T, atol=1e-6)
    if kw.get("order"):
        size = np.linalg.norm(arrays(model.coeffs, "a"), axis=0)
        assert (np.diff(size) < 0).all()
        np.testing.assert_allclose(model.g.T @ model.g, np.eye(3), atol=1e-8)


@pytest.mark.parametrize("conv, tol", [("max_frac_G", 1e-6), ("max_frac_A", 1e-6), ("rel_frac_loss", 1e-5)])
def test_convergence(df, problem, conv, tol):
    every = 2
    model = Factorizer(3, scale=Q, conv=conv, tol=tol, check_every=every, max_iter=40).fit(df)
    assert model.converged and model.n_iter < 40 and (model.n_iter - 1) % every == 0
    assert len(model.loss_history) == model.n_iter
    a, g, history = twin.fit(problem.y, problem.w, 3, Q * Q, model.n_iter)
    np.testing.assert_allclose(product(model), a @ g.T, atol=1e-6)
    np.testing.assert_allclose(model.loss_history, history, rtol=1e-8)


@pytest.mark.parametrize("conv, tol", [("max_frac_A", 1e-6), ("rel_frac_loss", 1e-5)])
def test_convergence_in_the_last_cycle(df, conv, tol):
    """A fit that settles at a check keeps its verdict when that is also the last cycle allowed."""
    kw = {"scale": Q, "conv": conv, "tol": tol, "check_every": 2}
    n = Factorizer(3, **kw, max_iter=40).fit(df).n_iter
    assert Factorizer(3, **kw, max_iter=n).fit(df).converged
    assert not Factorizer(3, **kw, max_iter=n - 1, order=True).fit(df).converged


def test_frac_change():
    m = np.ones((4, 4))
    assert frac_change(m, m) == 0
    n = m.copy()
    n[0, 0] = 1e4
    assert frac_change(n, m) > 1


def test_bad_cells_get_low_weights_and_clean_ones_are_recovered(df, problem):
    model = Factorizer(3, scale=Q, tol=1e-6, check_every=5).fit(df)
    w = arrays(model.apply(), "w_rob")
    ok = (problem.w > 0) & ~problem.bad
    assert np.median(w[problem.bad]) < 0.1 and np.median(w[ok]) > 0.9
    assert np.abs(product(model) - problem.clean)[ok].max() < 0.6
    assert (w[problem.w == 0] == 1).all()


def test_warm_start_and_custom_start(df, problem):
    first = Factorizer(3, scale=Q, conv="none", max_iter=2).fit(df)
    more = Factorizer(3, scale=Q, conv="none", max_iter=2).fit(df, start=first)
    a, g, history = twin.fit(problem.y, problem.w, 3, Q * Q, 4)
    np.testing.assert_allclose(product(more), a @ g.T, atol=1e-6)
    # a basis alone: coefficients come from the data weights
    alone = Factorizer(3, scale=Q, conv="none", max_iter=2).fit(df, start=(first.g, None))
    a0 = twin.lstsq_rows(problem.y, problem.w, first.g)
    a, g, _ = twin.fit(problem.y, problem.w, 3, Q * Q, 2, start=(a0, first.g))
    np.testing.assert_allclose(product(alone), a @ g.T, atol=1e-6)
    with pytest.raises(ValueError):
        Factorizer(3, scale=Q).fit(df, start=(first.g[:, :2], None))
    with pytest.raises(ValueError):
        Factorizer(3, scale=Q).fit(df, start=(first.g, first.coeffs.limit(5)))


def test_random_start_depends_on_seed_only(df, spark):
    kw = {"scale": Q, "init": "random", "conv": "none", "max_iter": 2}
    one, two = Factorizer(2, seed=1, **kw).fit(df, buckets=2), Factorizer(2, seed=1, **kw).fit(df.repartition(2), buckets=5)
    other = Factorizer(2, seed=2, **kw).fit(df)
    np.testing.assert_allclose(product(one), product(two), atol=1e-8)
    assert abs(one.loss_history[0] - other.loss_history[0]) > 1
    draws = np.array(spark.range(4000).select(start.random_coeffs(F.col("id"), 1, 2).alias("a")).toPandas()["a"].tolist())
    assert np.abs(draws.mean(axis=0)).max() < 0.06 and np.abs(draws.std(axis=0) - 1).max() < 0.05


def test_many_models_in_one_pass_equal_separate_fits(spark, problem, df):
    other = Problem(n=90, m=40, seed=5)
    both = df.select(F.lit(0).alias("grp"), "obj_id", "y", "w").unionByName(other.frame(spark).select(F.lit(4).alias("grp"), "obj_id", "y", "w"))
    specs = [ModelSpec("a", 2, Cauchy(2.0)), ModelSpec("b", 3, Cauchy(Q)), ModelSpec("c", 3, Cauchy(Q), 4)]
    fits = fit_many(both, specs, Settings(tol=1e-5, check_every=2, max_iter=30))
    assert {m.n_iter for m in fits.values()} != {30}
    for p, name, k, q in ((problem, "a", 2, 2.0), (problem, "b", 3, Q), (other, "c", 3, Q)):
        a, g, history = twin.fit(p.y, p.w, k, q * q, fits[name].n_iter)
        np.testing.assert_allclose(product(fits[name]), a @ g.T, atol=1e-5)
        np.testing.assert_allclose(fits[name].loss_history, history, rtol=1e-8)


def test_objects_and_features_without_data(spark):
    p = Problem(n=40, m=12, k=2, seed=2)
    p.y[3], p.w[3] = 0, 0
    p.y[:, 5], p.w[:, 5] = 0, 0
    model = Factorizer(2, scale=Q, conv="none", max_iter=3).fit(p.frame(spark))
    rows = {r["obj_id"]: r for r in model.coeffs.collect()}
    assert rows[3]["a"] is None and rows[3]["n_valid"] == 0 and rows[4]["n_valid"] > 0
    assert (model.g[5] == 0).all() and np.isfinite(model.g).all()
    scored = {r["obj_id"]: r for r in model.score(p.frame(spark)).collect()}
    assert scored[3]["p01"] == 1.0 and scored[3]["n_valid"] == 0


def test_input_is_checked(spark, problem, df):
    with pytest.raises(ValueError):
        Factorizer(41, scale=Q).fit(df)
    with pytest.raises(ValueError):
        Factorizer(0)
    for bad in ({"init": "x"}, {"conv": "x"}, {"rotation": "x"}, {"ridge": -1.0}, {"max_iter": 0}):
        with pytest.raises(ValueError):
            Factorizer(2, **bad)
    with pytest.raises(ValueError):
        Factorizer(2, scale=Q).fit(df.limit(0))
    with pytest.raises(Exception, match="unique"):
        Factorizer(2, scale=Q, conv="none", max_iter=3).fit(df.unionByName(df))
    ragged = df.withColumn("y", F.when(F.col("obj_id") == 7, F.slice("y", 1, 5)).otherwise(F.col("y")))
    with pytest.raises(Exception, match="features"):
        Factorizer(2, scale=Q).fit(ragged)


def test_ridge_shrinks(df):
    free = Factorizer(2, scale=Q, conv="none", max_iter=2).fit(df)
    held = Factorizer(2, scale=Q, conv="none", max_iter=2, ridge=500.0).fit(df)
    assert np.linalg.norm(product(held)) < np.linalg.norm(product(free))


def test_inference_and_scores(df, problem):
    model = Factorizer(3, scale=Q, conv="none", max_iter=4).fit(df)
    got = arrays(model.infer(df, n_steps=6), "a")
    np.testing.assert_allclose(got, twin.infer(problem.y, problem.w, model.g, Q * Q, 6), rtol=1e-7)
    a = twin.infer(problem.y, problem.w, model.g, Q * Q, 6)
    w = twin.q2_weight(problem.w, problem.y - a @ model.g.T, Q * Q)
    rows = model.score(df, scores=("p01", "median", "mean"), n_steps=6).orderBy("obj_id").toPandas()
    np.testing.assert_allclose(rows["p01"], np.percentile(w, 1, axis=1), rtol=1e-7)
    np.testing.assert_allclose(rows["median"], np.median(w, axis=1), rtol=1e-7)
    np.testing.assert_allclose(rows["mean"], w.mean(axis=1), rtol=1e-7)
    assert (rows["is_outlier"] == (rows["p01"] < 0.5)).all()
    present = model.score(df, scores=("median",), n_steps=6, missing="skip").orderBy("obj_id").toPandas()
    np.testing.assert_allclose(present["median"], [np.median(w[i][problem.w[i] > 0]) for i in range(problem.n)], rtol=1e-7)


def test_cell_steps_of_higher_rank(spark, df, problem):
    cells = prepare.objects_to_cells(df)
    rng = np.random.default_rng(1)
    g = rng.normal(size=(problem.m, 3))
    basis = spark.createDataFrame([(j, r.tolist()) for j, r in enumerate(g)], "feat_id int, g array<double>")
    coeffs = ops.a_step(cells, basis, 3)
    a = twin.lstsq_rows(problem.y, problem.w, g)
    np.testing.assert_allclose(arrays(coeffs, "a"), a, rtol=1e-7)
    new = ops.g_step(cells, coeffs, 3)
    np.testing.assert_allclose(arrays(new, "g", "feat_id"), twin.lstsq_rows(problem.y.T, problem.w.T, a), rtol=1e-7)


def test_singular_values_both_ways(spark, df, problem):
    passes = Passes(df.withColumn("grp", F.lit(0)), ["y", "w"])
    want = np.linalg.svd(problem.y)[1][:4]
    s, v = start.top_singular(passes, {0: 4})[0]
    np.testing.assert_allclose(s, want, rtol=1e-9)
    # a block as wide as the matrix is its Gram matrix; a narrow one finds the same
    s2, v2 = start.top_singular(passes, {0: 4}, oversample=1)[0]
    np.testing.assert_allclose(s2, want, rtol=1e-9)
    np.testing.assert_allclose(np.abs(v.T @ v2), np.eye(4), atol=1e-7)


def test_singular_values_of_a_wide_matrix(spark, monkeypatch):
    """5,000 features, a slowly falling spectrum, and a space that is cut back on the way."""
    rng = np.random.default_rng(5)
    u, v = np.linalg.qr(rng.normal(size=(120, 120)))[0], np.linalg.qr(rng.normal(size=(5000, 120)))[0]
    size = 10 * 0.93 ** np.arange(120)
    y = (u * size) @ v.T
    rows = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(y)], "grp int, obj_id bigint, y array<double>").repartition(4)
    passes = Passes(rows, ["y"])
    monkeypatch.setattr(start, "SPACE", 40)
    s, found = start.top_singular(passes, {0: 6})[0]
    np.testing.assert_allclose(s, size[:6], rtol=1e-8)
    np.testing.assert_allclose(np.abs(found.T @ v[:, :6]), np.eye(6), atol=1e-8)


def test_driver_gets_no_normal_sums(df, monkeypatch):
    """The basis is solved where its sums are: a driver that could not take them gives the same fit."""
    from plumbline.plans import passes

    options = {"scale": Q, "init": "random", "conv": "none", "max_iter": 3}
    plain = Factorizer(3, **options).fit(df)
    monkeypatch.setattr(passes, "DRIVER_BYTES", 200)
    tiny = Factorizer(3, **options).fit(df)
    np.testing.assert_allclose(product(tiny), product(plain), atol=1e-9)
    np.testing.assert_allclose(tiny.loss_history, plain.loss_history, rtol=1e-12)


def test_gradient_fit_descends_to_the_alternating_one(df):
    als = Factorizer(3, scale=Q, tol=1e-8, check_every=5).fit(df)
    sgd = Factorizer(3, scale=Q, method="sgd", learning_rate=0.02, conv="none", max_iter=15).fit(df)
    assert len(sgd.loss_history) == 15 and sgd.loss_history[-1] < sgd.loss_history[0]
    assert sgd.loss_history[-1] < als.loss_history[-1] * 1.5
    # the history is that of the returned factors
    r = arrays(df, "y") - product(sgd)
    assert sgd.loss_history[-1] == pytest.approx(twin.q2_loss(arrays(df, "w"), r, Q * Q), rel=1e-9)


def test_pursuit_equals_the_twin(spark, problem):
    low, sparse, err = twin.pursuit(problem.y, 6)
    p = baselines.pursuit(problem.frame(spark).select("obj_id", "y"), max_iter=6)
    np.testing.assert_allclose(arrays(p.parts, "l"), low, atol=1e-7)
    np.testing.assert_allclose(arrays(p.parts, "s"), sparse, atol=1e-7)
    assert p.n_iter == 6 and p.error == pytest.approx(err, rel=1e-6)


def test_principal_components(spark, problem):
    rows = problem.frame(spark).select("obj_id", "y")
    pc = baselines.principal_components(rows, 3)
    u, s, vt = np.linalg.svd(problem.y, full_matrices=False)
    np.testing.assert_allclose(arrays(pc.project(rows), "pred"), problem.y @ vt[:3].T @ vt[:3], atol=1e-8)


def test_gradient_fit_rotates_on_the_way_and_refuses_what_it_ignores(df):
    turned = Factorizer(3, scale=Q, method="sgd", learning_rate=0.02, conv="none", max_iter=15, rotate_every=5).fit(df)
    assert len(turned.loss_history) == 15 and turned.loss_history[-1] < turned.loss_history[0]
    for bad in ({"rotate_every": 5}, {"optimiser": Momentum(1e-3)}, {"method": "sgd", "rotate_every": 0}, {"method": "sgd", "reweight": "each"}):
        with pytest.raises(ValueError):
            Factorizer(3, **bad)


def heavy(rate):
    """Momentum written by a user, who keeps the count of steps as a second moment. A class of its own module must be on the
    workers' path; one made here travels by value."""

    class Heavy:
        moments = 2

        def step(self, grad, moments, n):
            assert (moments[1] == n).all()
            along = 0.8 * moments[0] + grad
            return along, (along, moments[1] + 1)

        def scale(self, step_mean2, parameter_mean2):
            return rate

    return Heavy()


def own_start(objects, k):
    first = np.array([r["y"] for r in objects.orderBy("obj_id").limit(k).collect()]).T
    return first, objects.select("obj_id", F.array(*[F.lit(0.1 * (i + 1)) for i in range(k)]).alias("a"))


def by_numpy(problem, steps, rate, check_every, tol):
    """The same steps on whole matrices, stopped by the change of A as the library documents it."""
    g = problem.y[:3].T.copy()
    a = np.tile([0.1, 0.2, 0.3], (problem.n, 1))
    ma, mg, seen = np.zeros_like(a), np.zeros_like(g), a.copy()
    for i in range(steps):
        r = problem.y - a @ g.T
        pull = -2.0 * problem.w * (Q * Q / (Q * Q + problem.w * r * r)) * r
        ma, mg = 0.8 * ma + pull @ g, 0.8 * mg + pull.T @ a
        a, g = a - rate * ma, g - rate * mg
        if i and i % check_every == 0:
            if ((a - seen) ** 2).max() / (a * a).mean() < tol:
                return a, g, i + 1, True
            seen = a.copy()
    return a, g, steps, False


@pytest.mark.parametrize("steps, tol", [(9, 0.0), (9, 1e9), (14, 1e-3)])
def test_an_optimiser_and_a_start_of_ones_own_equal_numpy(df, problem, tol, steps):
    a, g, n, done = by_numpy(problem, steps, 2e-5, 4, tol)
    m = Factorizer(3, scale=Q, method="sgd", optimiser=heavy(2e-5), init=own_start, conv="max_frac_A", tol=tol, check_every=4, max_iter=steps).fit(df)
    assert (m.n_iter, m.converged) == (n, done) and len(m.loss_history) == n
    np.testing.assert_allclose(m.g, g, rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose(arrays(m.coeffs, "a"), a, rtol=1e-8, atol=1e-10)


def test_a_stopping_rule_of_ones_own(df):
    seen = []

    def rule(check):
        seen.append((check.n_iter, len(check.losses), check.g.shape))
        return check.n_iter >= 5

    m = Factorizer(3, scale=Q, conv=rule, check_every=2, max_iter=20).fit(df)
    assert seen == [(3, 2, (40, 3)), (5, 4, (40, 3))]
    assert m.n_iter == 5 and m.converged and len(m.loss_history) == 5
    same = Factorizer(3, scale=Q, conv="none", max_iter=5).fit(df)
    np.testing.assert_allclose(product(m), product(same), atol=1e-9)


@pytest.mark.parametrize("method", ["als", "sgd"])
def test_a_fit_that_went_bad_tells_where(spark, problem, method):
    y = problem.y.copy()
    y[7, 3] = np.nan
    w = problem.w.copy()
    w[7, 3] = 1.0
    rows = [(i, y[i].tolist(), w[i].tolist()) for i in range(problem.n)]
    bad = spark.createDataFrame(rows, "obj_id bigint, y array<double>, w array<double>")
    options = {"order": True} if method == "als" else {"method": "sgd"}
    m = Factorizer(3, scale=Q, init="random", conv="none", max_iter=5, **options).fit(bad)
    assert not m.converged and m.n_iter == 1
    (counts,) = [tuple(r) for r in m.nan_counts.select("iter", "nan_a", "nan_g", "nan_w").collect()]
    assert counts == ((0, 3, 120, 1) if method == "als" else (0, 0, 3, 1))
    fine = Factorizer(3, scale=Q, init="random", conv="none", max_iter=2).fit(problem.frame(spark))
    assert fine.nan_history == [(0, 0, 0)] * 2


def test_sums_gathered_and_shuffled_are_the_same(spark):
    from plumbline.plans import passes

    rng = np.random.default_rng(2)
    shapes, ranks = {0: (5, 9), 1: (3, 70), 2: (1, 5)}, {0: 3}
    mats = [[np.hstack([np.tile([2.0, 0, 0, 2, 0, 2], (5, 1)), rng.normal(size=(5, 3))]), rng.normal(size=(3, 70)), rng.normal(size=(1, 5))] for _ in range(4)]
    rows = [(m, r, c // 64, row[c : c + 64].tolist()) for task in mats for m, v in enumerate(task) for r, row in enumerate(v) for c in range(0, v.shape[1], 64)]
    rows += [(-3, 0, 0, [float(i)]) for i in range(4)]
    df = spark.createDataFrame(rows, "mat int, r int, chunk int, vec array<double>").repartition(3)
    wide = passes.collect_sums(df, shapes, ranks)
    for written in (True, False):
        few = passes.collect_sums(df, shapes, ranks, tasks=4, written=written)
        assert sorted(few) == sorted(wide) and all(np.allclose(few[m], wide[m]) for m in wide)
    total = [sum(task[m] for task in mats) for m in range(3)]
    assert np.allclose(wide[0], total[0][:, 6:] / 8.0) and np.allclose(wide[1], total[1]) and wide[-3] == [3.0]


def _written(monkeypatch) -> list[str]:
    from plumbline.runtime import Scratch

    names, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name, *rest, **more: names.append(name) or put(self, df, name, *rest, **more))
    return names


def test_a_small_fit_writes_its_coefficients_seldom(df, problem, monkeypatch):
    names = _written(monkeypatch)
    model = Factorizer(3, scale=Q, conv="none", max_iter=12).fit(df)
    # objects, first cycle, end
    assert len(names) == 3
    a, g, history = twin.fit(problem.y, problem.w, 3, Q * Q, 12)
    np.testing.assert_allclose(product(model), a @ g.T, atol=1e-6)
    np.testing.assert_allclose(model.loss_history, history, rtol=1e-9)
    names.clear()
    monkeypatch.setattr("plumbline.plans.fit.AGAIN_CYCLES", 4)
    again = Factorizer(3, scale=Q, conv="none", max_iter=12).fit(df)
    assert len(names) == 5
    np.testing.assert_allclose(product(again), product(model), atol=1e-9)


@pytest.mark.parametrize("limit", ["plans.fit.AGAIN_WORK", "plans.passes.HOLD_BYTES", "plans.passes.GATHER_BYTES"])
def test_a_large_fit_writes_every_cycle(df, monkeypatch, limit):
    monkeypatch.setattr(f"plumbline.{limit}", 0)
    names = _written(monkeypatch)
    Factorizer(2, scale=Q, conv="none", max_iter=4).fit(df)
    assert len(names) == 6


@pytest.mark.parametrize("conv, kw", [("max_frac_A", {}), ("rel_frac_loss", {"order": True}), ("max_frac_G", {"reweight": "each", "ridge": 1e-3, "init": "random"})])
def test_unwritten_cycles_change_nothing(spark, df, monkeypatch, conv, kw):
    other = Problem(n=90, m=40, seed=5)
    both = df.select(F.lit(0).alias("grp"), "obj_id", "y", "w").unionByName(other.frame(spark).select(F.lit(4).alias("grp"), "obj_id", "y", "w"))
    specs = [ModelSpec("a", 2, Cauchy(2.0)), ModelSpec("b", 3, Cauchy(Q)), ModelSpec("c", 3, Cauchy(Q), 4)]
    settings = Settings(conv=conv, tol=1e-2, check_every=2, max_iter=7, **kw)
    names = _written(monkeypatch)
    seldom = fit_many(both, specs, settings)
    assert len(names) == 3
    monkeypatch.setattr("plumbline.plans.fit.AGAIN_CYCLES", 1)
    always = fit_many(both, specs, settings)
    assert len(names) >= 3 + 2 + max(m.n_iter for m in always.values())
    for name, m in always.items():
        s = seldom[name]
        assert (s.n_iter, s.converged, s.nan_history) == (m.n_iter, m.converged, m.nan_history)
        np.testing.assert_allclose(s.loss_history, m.loss_history, rtol=1e-9)
        np.testing.assert_allclose(s.g, m.g, atol=1e-7)
        np.testing.assert_allclose(arrays(s.coeffs, "a"), arrays(m.coeffs, "a"), atol=1e-7)
