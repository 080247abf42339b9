import numpy as np
import pytest

from plumbline import Cauchy
from plumbline.functions import kernels
from plumbline.plans import rotate
import twin

SHAPES = [(6, 5, 3), (6, 6, 3), (5, 6, 3), (6, 5, 5), (5, 6, 5), (101, 101, 5)]


def problem(n, m, k, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, m)), rng.uniform(0.5, 2, size=(n, m)), rng.normal(size=(n, k)), rng.normal(size=(m, k))


@pytest.mark.parametrize("shape", SHAPES)
def test_half_steps_satisfy_the_normal_equations(shape):
    y, w, a, g = problem(*shape)
    new = kernels.a_step(y, w, g)
    assert np.abs((w * (y - new @ g.T)) @ g).max() < 1e-8
    k = shape[2]
    sums = kernels.g_sums(y, w, a)
    p = k * (k + 1) // 2
    gn = kernels.solve_packed(sums[:, :p], sums[:, p:])
    assert np.abs((w * (y - a @ gn.T)).T @ a).max() < 1e-8


def test_rows_without_data_and_singular_rows():
    y, w, _, g = problem(6, 5, 3)
    w[0], w[1, 1:] = 0.0, 0.0
    a = kernels.a_step(y, w, g)
    assert (a[0] == 0).all() and np.isfinite(a).all()
    # one valid cell cannot fix three numbers: the shortest solution still meets it
    assert a[1] @ g[0] == pytest.approx(y[1, 0])
    np.testing.assert_allclose(a[2:], twin.lstsq_rows(y[2:], w[2:], g), rtol=1e-8)


def test_few_valid_cells_do_not_depend_on_neighbours():
    y, w, _, g = problem(60, 8, 3)
    for i in range(60):
        w[i, i % 4 :] = 0.0  # 0, 1, 2 or 3 cells for three numbers
    whole = kernels.a_step(y, w, g)
    alone = np.vstack([kernels.a_step(y[i : i + 1], w[i : i + 1], g) for i in range(60)])
    np.testing.assert_allclose(whole, alone, rtol=1e-9, atol=1e-12)
    want = [np.linalg.lstsq(np.sqrt(wi)[:, None] * g, np.sqrt(wi) * yi, rcond=1e-8)[0] for yi, wi in zip(y, w)]
    np.testing.assert_allclose(whole, want, rtol=1e-6, atol=1e-9)


def test_rows_that_are_not_finite_spoil_no_others():
    y, w, _, g = problem(6, 5, 3)
    good = kernels.a_step(y, w, g)
    y[2, 0] = np.inf
    with np.errstate(invalid="ignore"):
        got = kernels.a_step(y, w, g)
    assert np.isnan(got[2]).all()
    np.testing.assert_array_equal(np.delete(got, 2, 0), np.delete(good, 2, 0))


def test_irls_matches_the_twin_and_stops_per_object():
    y, w, _, g = problem(50, 20, 3)
    y[0] += 30
    a, steps = kernels.irls(y, w, g, Cauchy(2.0), max_iter=7, tol=0.0)
    np.testing.assert_allclose(a, twin.infer(y, w, g, 4.0, 7), rtol=1e-9)
    assert (steps == 7).all()
    a1, s1 = kernels.irls(y, w, g, Cauchy(2.0), max_iter=500, tol=1e-8, cadence=5)
    a2 = np.vstack([kernels.irls(y[i : i + 1], w[i : i + 1], g, Cauchy(2.0), max_iter=500, tol=1e-8, cadence=5)[0] for i in range(50)])
    np.testing.assert_allclose(a1, a2, rtol=1e-9)
    assert s1.min() < s1.max()


def test_stopping_rules_of_inference():
    y, w, _, g = problem(40, 20, 3)
    y[::7] += 20
    loss, history = Cauchy(2.0), []
    a, steps = kernels.irls(y, w, g, loss, max_iter=300, tol=1e-9, cadence=5, conv="rel_frac_loss", history=history)
    assert steps.max() < 300 and len(set(steps.tolist())) > 1
    for i in range(40):
        # the check falls on steps 6, 11, 16, ...: each one's loss is that of so many steps
        at = [kernels.irls(y[i : i + 1], w[i : i + 1], g, loss, max_iter=n, conv="none")[0] for n in [0, *range(6, steps[i] + 1, 5)]]
        want = [float(loss.loss_np(w[i], y[i] - (x @ g.T)[0]).sum()) for x in at]
        np.testing.assert_allclose(history[i], want, rtol=1e-9)
        assert abs(history[i][-1] - history[i][-2]) <= 1e-9 * history[i][-1]
    _, steps = kernels.irls(y, w, g, loss, max_iter=30, conv="none")
    assert (steps == 30).all()


@pytest.mark.parametrize("target", ["A", "G"])
@pytest.mark.parametrize("white", [True, False])
def test_rotations_keep_the_product(target, white):
    _, _, a, g = problem(30, 20, 4)
    t, h = rotate.whiten(a.T @ a, g.T @ g, target, white)
    np.testing.assert_allclose((a @ t) @ (g @ h).T, a @ g.T, atol=1e-9)
    x = a @ t if target == "A" else g @ h
    gram = x.T @ x
    if white:
        np.testing.assert_allclose(gram, np.eye(4), atol=1e-5)
    else:
        np.testing.assert_allclose(gram, np.diag(np.diag(gram)), atol=1e-9)


def test_principal_rotation_is_the_svd_of_the_product():
    _, _, a, g = problem(30, 20, 4)
    t, h = rotate.principal(a.T @ a, g.T @ g)
    np.testing.assert_allclose((a @ t) @ (g @ h).T, a @ g.T, atol=1e-9)
    np.testing.assert_allclose((g @ h).T @ (g @ h), np.eye(4), atol=1e-9)
    s = np.linalg.norm(a @ t, axis=0)
    np.testing.assert_allclose(s, np.linalg.svd(a @ g.T)[1][:4], rtol=1e-9)
    # turning what is turned already changes nothing
    t2, h2 = rotate.principal((a @ t).T @ (a @ t), (g @ h).T @ (g @ h))
    np.testing.assert_allclose(h2, np.eye(4), atol=1e-8)


def test_unknown_target():
    with pytest.raises(ValueError):
        rotate.whiten(np.eye(2), np.eye(2), "B")
