"""Queries that run the fitting and scoring plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline import Cauchy, Factorizer, Gaussian, ModelSpec
from plumbline.functions.scores import ARRAY_SCORES
from plumbline.operators import bins, cells as ops, diagnose, prepare
from plumbline.plans import baselines, population, score as scoring, start
from plumbline.plans.fit import FittedModel, Settings
from plumbline.plans.optimisers import Momentum
from plumbline.plans.passes import Passes
from plumbline.runtime import checkpointed, scratch_path
from plumbline.sources import store
from plumbline.streaming.score_stream import read_stream, score_stream
from plumbline.workload.inputs import DENSE, N_MONTHS, PRICES, Q, Q2, als_sql, basis_array, components_sql, price_objects, query, rd, table, tidy, unit


def _objects(spark, sf_dir):
    return checkpointed(price_objects(spark, sf_dir))


def _mean_start(objects):
    """Weighted means as basis and ones as coefficients."""
    g = basis_array(ops.mean_basis(prepare.objects_to_cells(objects)), N_MONTHS, 1)
    return g, objects.select("obj_id", F.array(F.lit(1.0)).alias("a"))


def _rank1_fit(spark, sf_dir, steps, **kw):
    objects = _objects(spark, sf_dir)
    loss = kw.pop("loss", Cauchy(Q))
    est = Factorizer(1, loss=loss, conv="none", max_iter=steps, **kw)
    return objects, est.fit(objects, start=_mean_start(objects))


def _cells_of(model):
    rows = model.apply()
    return prepare.objects_to_cells(rows, ("w", "pred", "r", "w_rob")).filter("w > 0")


def _fit_sql(steps: int, robust: bool = True, each: bool = False) -> str:
    f = f"{Q2} / ({Q2} + w * (y - a*g) * (y - a*g))" if robust else "1.0::DOUBLE"
    return f"""WITH {als_sql(steps, robust, each)}
SELECT obj_id, feat_id, {rd("a * g")} AS pred, {rd(f)} AS w_rob FROM cells JOIN a{steps} USING (obj_id) JOIN g{steps} USING (feat_id)"""


def _fitted_cells(objects, model):
    return tidy(_cells_of(model).select("obj_id", "feat_id", "pred", "w_rob"))


@query(_fit_sql(3))
def robust_fit_rank1(spark, sf_dir):
    return _fitted_cells(*_rank1_fit(spark, sf_dir, 3))


@query(_fit_sql(3, robust=False))
def gaussian_fit_rank1(spark, sf_dir):
    return _fitted_cells(*_rank1_fit(spark, sf_dir, 3, loss=Gaussian()))


@query(_fit_sql(2, each=True))
def reweighted_fit_rank1(spark, sf_dir):
    """Weights refreshed before each half step."""
    return _fitted_cells(*_rank1_fit(spark, sf_dir, 2, reweight="each"))


_LOSSES = als_sql(3)


@query("WITH " + _LOSSES + " " + " UNION ALL ".join(
    f"SELECT {i - 1} AS iter, {rd(f'{Q2} * sum(ln(1 + w * (y - a*g) * (y - a*g) / {Q2}))', 4)} AS loss FROM cells JOIN a{i} USING (obj_id) JOIN g{i} USING (feat_id)"
    for i in (1, 2, 3)
))
def loss_history(spark, sf_dir):
    _, model = _rank1_fit(spark, sf_dir, 3)
    return tidy(model.history.select("iter", "loss"), 4)


def _rank2_tables(steps: int) -> str:
    """Two-component cycles written out, from the weighted mean and a straight line."""

    def step(i: int) -> str:
        p = i - 1
        robust = f"w * {Q2} / ({Q2} + w * (y - a1*g1 - a2*g2) * (y - a1*g1 - a2*g2))"
        return f""",
v{i} AS (SELECT obj_id, feat_id, y, {robust} AS w FROM cells JOIN x{p} USING (obj_id) JOIN h{p} USING (feat_id)),
x{i} AS (SELECT obj_id, {solve.format(v="a")} FROM (SELECT obj_id, {sums.format(v="g")} FROM v{i} JOIN h{p} USING (feat_id) GROUP BY 1)),
h{i} AS (SELECT feat_id, {solve.format(v="g")} FROM (SELECT feat_id, {sums.format(v="a")} FROM v{i} JOIN x{i} USING (obj_id) GROUP BY 1))"""

    solve = "(s*b1 - q*b2) / (p*s - q*q) AS {v}1, (p*b2 - q*b1) / (p*s - q*q) AS {v}2"
    sums = "sum(w*{v}1*{v}1) AS p, sum(w*{v}1*{v}2) AS q, sum(w*{v}2*{v}2) AS s, sum(w*y*{v}1) AS b1, sum(w*y*{v}2) AS b2"
    first = f"""WITH {PRICES},
h0 AS (SELECT feat_id, sum(w * y) / sum(w) AS g1, (feat_id - 41) / 41.0::DOUBLE AS g2 FROM cells GROUP BY 1),
x0 AS (SELECT obj_id, {solve.format(v="a")} FROM (SELECT obj_id, {sums.format(v="g")} FROM cells JOIN h0 USING (feat_id) GROUP BY 1))"""
    return first + "".join(step(i) for i in range(1, steps + 1))


def _rank2_sql() -> str:
    return _rank2_tables(2) + f"""
SELECT obj_id, feat_id, {rd("a1*g1 + a2*g2")} AS pred, {rd(f"{Q2} / ({Q2} + w * (y - a1*g1 - a2*g2) * (y - a1*g1 - a2*g2))")} AS w_rob
FROM cells JOIN x2 USING (obj_id) JOIN h2 USING (feat_id)"""


def _two_vectors(objects):
    g = basis_array(ops.mean_basis(prepare.objects_to_cells(objects)), N_MONTHS, 1)
    return np.hstack([g, np.where(g > 0, (np.arange(N_MONTHS) - 41)[:, None] / 41.0, 0.0)])


@query(_rank2_sql())
def robust_fit_rank2(spark, sf_dir):
    """Two cycles at rank two, whitened in between; the product does not depend on the rotation."""
    objects = _objects(spark, sf_dir)
    model = Factorizer(2, scale=Q, conv="none", max_iter=2).fit(objects, start=(_two_vectors(objects), None))
    return _fitted_cells(objects, model)


def _infer_sql(select: str, steps: int = 5, tail: str = "") -> str:
    out = DENSE
    prev = "coeffs"
    for i in range(1, steps + 1):
        out += f""",
i{i} AS (SELECT obj_id, sum(u * y * g) / sum(u * g * g) AS a FROM (
  SELECT obj_id, y, g, w * {Q2} / ({Q2} + w * (y - a*g) * (y - a*g)) AS u FROM cells JOIN basis USING (feat_id) JOIN {prev} USING (obj_id)) GROUP BY 1)"""
        prev = f"i{i}"
    out += f""",
final AS (SELECT obj_id, feat_id, w, {Q2} / ({Q2} + w * (y - a*g) * (y - a*g)) AS w_rob FROM cells JOIN basis USING (feat_id) JOIN {prev} USING (obj_id)),
full_rows AS (SELECT obj_id, feat_id, coalesce(final.w, 0) AS w, coalesce(final.w_rob, 1) AS w_rob FROM grid LEFT JOIN final USING (obj_id, feat_id))"""
    return f"WITH {out} {select.format(last=prev)}"


def _fixed_model(spark, objects):
    g, _ = _mean_start(objects)
    return FittedModel(spark, ModelSpec("mean", 1, Cauchy(Q)), g)


@query(_infer_sql(f"SELECT obj_id, {rd('a')} AS a, 5 AS n_steps FROM {{last}}"))
def infer_fixed_basis(spark, sf_dir):
    objects = _objects(spark, sf_dir)
    rows = _fixed_model(spark, objects).infer(objects, n_steps=5)
    return tidy(rows.select("obj_id", F.col("a")[0].alias("a"), "n_steps"))


_SCORED = f"""SELECT obj_id, count(*) FILTER (WHERE w > 0)::INTEGER AS n_valid, {rd("quantile_cont(w_rob, 0.01)")} AS p01, {rd("median(w_rob)")} AS median,
{rd("avg(w_rob)")} AS mean, {rd('min(w_rob)')} AS "min", {rd("avg(CASE WHEN w_rob < 0.5 THEN 1.0 ELSE 0.0 END)")} AS frac_low, count(*) FILTER (WHERE w_rob < 0.3) AS n_low,
quantile_cont(w_rob, 0.01) < 0.7 AS is_outlier FROM full_rows {{where}} GROUP BY obj_id"""
_NAMES = ("p01", "median", "mean", "min", "frac_low", "n_low")


@query(_infer_sql(_SCORED.format(where="")))
def score_objects(spark, sf_dir):
    objects = _objects(spark, sf_dir)
    return tidy(_fixed_model(spark, objects).score(objects, scores=_NAMES, threshold=0.7, n_steps=5).drop("n_steps"))


@query(_infer_sql(_SCORED.format(where="WHERE w > 0")))
def score_objects_present(spark, sf_dir):
    objects = _objects(spark, sf_dir)
    return tidy(_fixed_model(spark, objects).score(objects, scores=_NAMES, threshold=0.7, n_steps=5, missing="skip").drop("n_steps"))


@query(_infer_sql(_SCORED.format(where="")))
def score_stream_available(spark, sf_dir):
    """The same scores from a file stream."""
    objects = _objects(spark, sf_dir)
    model = _fixed_model(spark, objects)
    base = scratch_path(spark, "stream")
    objects.write.parquet(f"{base}/in")
    q = score_stream(read_stream(spark, f"{base}/in", max_files=3), model, f"{base}/out", f"{base}/ckpt", once=True, scores=_NAMES, threshold=0.7, n_steps=5)
    q.awaitTermination()
    return tidy(spark.read.parquet(f"{base}/out").drop("n_steps"))


@query(_infer_sql(f"SELECT obj_id, feat_id, {rd('g * a')} AS pred FROM {{last}}, basis WHERE obj_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"))
def reconstruct_chosen(spark, sf_dir):
    objects = _objects(spark, sf_dir)
    model = _fixed_model(spark, objects)
    only = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("obj_id"))
    rows = scoring.reconstruct(model.infer(objects, n_steps=5), model, only)
    return tidy(prepare.objects_to_cells(rows, ("pred",)).filter("pred <> 0"))


_HELD_OUT = f"""SELECT bin, 1 AS k, {Q}::DOUBLE AS q, unnest(['std_z', 'chi2_red', 'rmse', 'mad_z', 'kl']) AS metric,
unnest([{rd("s")}, {rd("c")}, {rd("sqrt(c)")}, {rd("m")}, {rd("CASE WHEN s > 0 THEN -ln(s) + (s*s + u*u) / 2 - 0.5 END")}]) AS value
FROM (SELECT grid.obj_id % 3 AS bin, stddev_pop(coalesce(z, 0)) AS s, avg(coalesce(z, 0)) AS u, avg(coalesce(c, 0)) AS c, median(abs(coalesce(z, 0))) AS m
  FROM grid LEFT JOIN (SELECT obj_id, feat_id, w * (y - a*g) * (y - a*g) AS c, (y - a*g) * sqrt(w) * sqrt({Q2} / ({Q2} + w * (y - a*g) * (y - a*g))) AS z
    FROM cells JOIN basis USING (feat_id) JOIN {{last}} USING (obj_id)) held USING (obj_id, feat_id) GROUP BY 1)"""


@query(_infer_sql(_HELD_OUT))
def validation_metrics(spark, sf_dir):
    """Calibration of a model for each of three groups of suppliers: inferred, summed and the median found inside the map."""
    objects = _objects(spark, sf_dir)
    g, _ = _mean_start(objects)
    rows = objects.withColumn("bin", (F.col("obj_id") % 3).cast("int"))
    models = [FittedModel(spark, ModelSpec(population.model_name(b, 1, Q), 1, Cauchy(Q), b), g) for b in range(3)]
    return tidy(population.cross_validate(rows, models, max_iter=5, tol=0.0))


@query(f"""WITH {als_sql(3)} SELECT a.obj_id, {rd("a * (SELECT sqrt(sum(g * g)) FROM g3)", 5)} AS a, n_iter, k FROM a3 a, (SELECT 3 AS n_iter, 1 AS k)""")
def model_store(spark, sf_dir):
    """A model saved, listed, loaded and read back; its basis has unit length."""
    _, model = _rank1_fit(spark, sf_dir, 3)
    st = store.ModelStore(spark, scratch_path(spark, "models"))
    st.save(model)
    back = st.load("model")
    scale = float(np.sqrt((back.g**2).sum()))
    rows = back.coeffs.select("obj_id", (F.col("a")[0] * F.lit(scale)).alias("a"), F.lit(back.n_iter).alias("n_iter"), F.lit(back.k).alias("k"))
    return tidy(rows, 5)


QUERY_SQL = _infer_sql(f"SELECT obj_id, {rd('a')} AS a, {rd('a')} AS again FROM {{last}}")


@query(QUERY_SQL)
def cached_coeffs(spark, sf_dir):
    """Inferred on the first request, read on the second."""
    objects = _objects(spark, sf_dir)
    st = store.ModelStore(spark, scratch_path(spark, "models"))
    model = _fixed_model(spark, objects)
    # some objects first, then all: only the others are inferred
    st.cached_coeffs(model, objects.where("obj_id % 3 = 0"), n_steps=5)
    first = st.cached_coeffs(model, objects, n_steps=5)
    # other settings make no difference any more: the stored coefficients are used
    second = st.cached_coeffs(model, objects, n_steps=1)
    return tidy(first.join(second.select("obj_id", F.col("a").alias("b")), "obj_id").select("obj_id", F.col("a")[0].alias("a"), F.col("b")[0].alias("again")))


@query(_infer_sql(f"""SELECT obj_id, feat_id, {rd("y - a*g")} AS r FROM cells JOIN basis USING (feat_id) JOIN {{last}} USING (obj_id)
WHERE obj_id IN (SELECT obj_id FROM full_rows GROUP BY 1 HAVING quantile_cont(w_rob, 0.01) < 0.7)"""))
def residual_store(spark, sf_dir):
    """Residual vectors of the flagged objects, stored under their bin and read back."""
    objects = _objects(spark, sf_dir)
    model = _fixed_model(spark, objects)
    rows = scoring.infer_and_apply(objects, model, n_steps=5)
    low = rows.filter(ARRAY_SCORES["p01"](F.col("w_rob")) < 0.7)
    results = store.ResultStore(spark, scratch_path(spark, "results"))
    results.write("residuals", low.select("obj_id", "w", "r", F.lit("std_z").alias("metric"), (F.col("obj_id") % 3).cast("int").alias("bin")))
    back = results.read("residuals", "std_z")
    return tidy(prepare.objects_to_cells(back, ("w", "r")).filter("w > 0").drop("w"))


@query(f"""WITH {PRICES} SELECT obj_id, count(*) AS n, {rd("sum(y)", 5)} AS y, {rd("sum(sqrt((SELECT v FROM pool) / n))", 5)} AS sigma
FROM raw WHERE obj_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY obj_id""")
def objects_for_ids(spark, sf_dir):
    """Array rows of chosen objects only, from Parquet."""
    path = scratch_path(spark, "objects")
    price_objects(spark, sf_dir).withColumn("sigma", F.transform("w", lambda w: F.when(w > 0, F.lit(1.0) / F.sqrt(w)))).drop("w").write.parquet(path)
    ids = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("obj_id"))
    rows = prepare.prepare_objects(store.read_objects(spark, path, ids))
    cells = prepare.objects_to_cells(rows).filter("w > 0")
    return tidy(cells.groupBy("obj_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum(F.lit(1.0) / F.sqrt("w")).alias("sigma")), 5)


# --- starts -----------------------------------------------------------------------------------------


@query("""SELECT j::INTEGER AS feat_id, """ + rd("sum(embedding[j+1]::DOUBLE ** 2)") + """ AS energy
FROM embeddings, range(64) t(j) GROUP BY 1""")  # fmt: skip
def svd_energy(spark, sf_dir):
    """All singular values and vectors put together again give each feature's sum of squares."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obj_id"), F.col("embedding").cast("array<double>").alias("y"))
    pc = baselines.principal_components(rows, 64)
    energy = ((pc.vectors * pc.values) ** 2).sum(axis=1)
    return tidy(spark.createDataFrame([(j, float(e)) for j, e in enumerate(energy)], "feat_id int, energy double"))


@query(f"""WITH RECURSIVE {PRICES},
gram AS (SELECT a.feat_id AS i, b.feat_id AS j, sum(a.y * b.y) AS v FROM cells a JOIN cells b USING (obj_id) GROUP BY 1, 2),
{components_sql("gram", 4)}
{" UNION ALL ".join(f"SELECT {i}::INTEGER AS i, {rd(f'sqrt(l{i}.v)')} AS gram, {rd(f'sqrt(l{i}.v)')} AS sketch FROM l{i}" for i in range(4))}""")
def svd_start(spark, sf_dir):
    """Leading singular values of the prices from a block as wide as the matrix, which is its whole Gram matrix, and from a narrow one."""
    objects = price_objects(spark, sf_dir).withColumn("grp", F.lit(0))
    passes = Passes(objects, ["y", "w"])
    whole = start.top_singular(passes, {0: 4}, oversample=N_MONTHS)[0][0]
    sketch = start.top_singular(passes, {0: 4})[0][0]
    passes.scratch.drop("objects")
    return tidy(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(whole, sketch))], "i int, gram double, sketch double"))


def _normal_sql(seed: str, *keys: str) -> str:
    u, v = unit(f"{seed}/u", *keys), unit(f"{seed}/v", *keys)
    return f"sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v})"


@query(f"""SELECT s_suppkey AS obj_id, {rd(_normal_sql("5/A", "s_suppkey", "0"))} AS a0, {rd(_normal_sql("5/A", "s_suppkey", "1"))} AS a1 FROM supplier""")
def random_start(spark, sf_dir):
    a = start.random_coeffs(F.col("s_suppkey"), 5, 2)
    return tidy(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("obj_id"), a[0].alias("a0"), a[1].alias("a1")))


# --- whole fits, checked by tests against numpy ------------------------------------------------------


@query()
def robust_fit_rank3(spark, sf_dir):
    """Rank-three fit of the prices until the basis settles, ordered; scores of all suppliers."""
    objects = _objects(spark, sf_dir)
    model = Factorizer(3, scale=Q, tol=1e-4, check_every=5, order=True).fit(objects)
    return model.score(objects, scores=("p01", "median"))


_RULES = {"max_frac_G": 1e-6, "max_frac_A": 1e-6, "rel_frac_loss": 1e-5, "none": 0.0}
_CYCLES = 6


def _rules_sql() -> str:
    """When each rule stops a rank-one fit that is checked every cycle.

    The first cycle is not checked, and the first check looks back to the start. From the second
    cycle on the basis has unit length.
    """
    facts = []
    for i in range(1, _CYCLES + 1):
        loss = f"SELECT {i} AS i, (SELECT {Q2} * sum(ln(1 + w * (y - a*g) * (y - a*g) / {Q2})) FROM cells JOIN a{i} USING (obj_id) JOIN g{i} USING (feat_id)) AS loss"
        if i < 3:
            facts.append(f"{loss}, 1e9::DOUBLE AS fg, 1e9::DOUBLE AS fa")
            continue
        o, n = (f"(SELECT sqrt(sum(g * g)) FROM g{j})" for j in (i - 1, i))
        facts.append(f"""{loss},
  (SELECT max((o.g / {o} - n.g / {n}) ** 2) / sum((n.g / {n}) ** 2) * {N_MONTHS} FROM g{i - 1} o JOIN g{i} n USING (feat_id)) AS fg,
  (SELECT max((o.a * {o} - n.a * {n}) ** 2) / avg((n.a * {n}) ** 2) FROM a{i - 1} o JOIN a{i} n USING (obj_id)) AS fa""")
    picks = []
    for rule, tol in _RULES.items():
        cond = {"max_frac_G": f"fg < {tol}", "max_frac_A": f"fa < {tol}", "rel_frac_loss": f"change < {tol}", "none": "false"}[rule]
        picks.append(f"SELECT '{rule}' AS conv, min(i) FILTER (WHERE i >= 3 AND {cond}) AS stop FROM c")
    return f"""WITH {als_sql(_CYCLES)}, f AS ({" UNION ALL ".join(facts)}),
c AS (SELECT *, abs(lag(loss) OVER (ORDER BY i) - loss) / abs(loss) AS change FROM f),
p AS ({" UNION ALL ".join(picks)})
SELECT conv, coalesce(stop, {_CYCLES})::INTEGER AS n_iter, stop IS NOT NULL AS converged, {rd("loss", 4)} AS loss FROM p JOIN f ON f.i = coalesce(stop, {_CYCLES})"""


@query(_rules_sql())
def convergence_policies(spark, sf_dir):
    """Cycles, outcome and final loss of a rank-one fit under every stopping rule."""
    objects = _objects(spark, sf_dir)
    begin = _mean_start(objects)
    rows = []
    for conv, tol in _RULES.items():
        m = Factorizer(1, scale=Q, conv=conv, tol=tol, check_every=1, max_iter=_CYCLES).fit(objects, start=begin)
        rows.append((conv, m.n_iter, m.converged, m.loss_history[-1]))
    return tidy(spark.createDataFrame(rows, "conv string, n_iter int, converged boolean, loss double"), 4)


_ROTATIONS = {
    "fast": {}, "fast_a": {"target": "A"}, "axes": {"whiten": False}, "slow": {"rotation": "slow"}, "identity": {"rotation": "identity"},
}


@query(f"""{_rank2_tables(2)}, fin AS (SELECT {rd(f"{Q2} * sum(ln(1 + w * (y - a1*g1 - a2*g2) * (y - a1*g1 - a2*g2) / {Q2}))", 4)} AS loss
  FROM cells JOIN x2 USING (obj_id) JOIN h2 USING (feat_id))
SELECT rotation, loss, orthonormal FROM fin, (VALUES ('fast', true), ('fast_a', false), ('axes', false), ('slow', true), ('identity', false)) t(rotation, orthonormal)""")
def rotations(spark, sf_dir):
    """The same cycles under every rotation: the loss does not depend on it, the shape of the basis does."""
    objects = _objects(spark, sf_dir)
    rows = []
    for name, kw in _ROTATIONS.items():
        m = Factorizer(2, scale=Q, conv="none", max_iter=2, **kw).fit(objects, start=(_two_vectors(objects), None))
        rows.append((name, m.loss_history[-1], bool(np.abs(m.g.T @ m.g - np.eye(2)).max() < 1e-3)))
    return tidy(spark.createDataFrame(rows, "rotation string, loss double, orthonormal boolean"), 4)


def _gradients_sql(i: int) -> str:
    """Gradients of A and G at step i of rank one."""
    return f""",
p{i} AS (SELECT obj_id, feat_id, a, g, -2 * w * {Q2} / ({Q2} + w * (y - a*g) * (y - a*g)) * (y - a*g) AS pull FROM cells JOIN a{i} USING (obj_id) JOIN g{i} USING (feat_id)),
da{i} AS (SELECT obj_id, sum(pull * g) AS d FROM p{i} GROUP BY 1),
dg{i} AS (SELECT feat_id, sum(pull * a) AS d FROM p{i} GROUP BY 1)"""


def _gradient_sql(rate: float, n_features: int) -> str:
    """Two adaptive gradient steps at rank one. Features without data have a zero gradient and basis; they count in the means."""
    beta = 1 - 2.0**-0.9

    def move(i: int, side: str, key: str, n: str) -> str:
        v = f"{side}v{i + 1}"
        before = f"{beta!r}::DOUBLE * o.v + {1 - beta!r}::DOUBLE * d * d" if i else "d * d"
        old = f" JOIN {side}v{i} o USING ({key})" if i else ""
        return f""",
{v} AS (SELECT {key}, {before} AS v FROM d{side}{i}{old}),
{side}u{i} AS (SELECT {key}, CASE WHEN v > 0 THEN d / sqrt(v) ELSE 0 END AS u FROM d{side}{i} JOIN {v} USING ({key})),
{side}f{i} AS (SELECT {rate} / greatest(1.0, sqrt((SELECT sum(u * u) FROM {side}u{i}) / {n})) * greatest(sqrt((SELECT sum({side} * {side}) FROM {side}{i}) / {n}), 0.001) AS f),
{side}{i + 1} AS (SELECT {key}, {side} - f * u AS {side} FROM {side}{i} JOIN {side}u{i} USING ({key}), {side}f{i})"""

    out = als_sql(0)
    for i in range(2):
        out += _gradients_sql(i) + move(i, "a", "obj_id", "(SELECT count(*) FROM a0)") + move(i, "g", "feat_id", f"{n_features}.0::DOUBLE")
    return f"WITH {out} " + " UNION ALL ".join(
        f"SELECT {i - 1} AS iter, {rd(f'{Q2} * sum(ln(1 + w * (y - a*g) * (y - a*g) / {Q2}))', 4)} AS loss FROM cells JOIN a{i} USING (obj_id) JOIN g{i} USING (feat_id)"
        for i in (1, 2)
    )


@query(_gradient_sql(0.02, N_MONTHS))
def gradient_fit(spark, sf_dir):
    """Loss of two gradient steps from the weighted mean."""
    objects = _objects(spark, sf_dir)
    m = Factorizer(1, scale=Q, method="sgd", learning_rate=0.02, conv="none", max_iter=2).fit(objects, start=_mean_start(objects))
    return tidy(m.history.select("iter", "loss"), 4)


# Settings of the fit by an optimiser of one's own: rate, momentum, steps.
_OWN = (1e-7, 0.5, 3)


def _momentum_sql() -> str:
    rate, beta, steps = _OWN
    out = als_sql(0)
    for i in range(steps):
        out += _gradients_sql(i)
        for side, key in (("a", "obj_id"), ("g", "feat_id")):
            u = f"{beta} * o.u + d" if i else "d"
            old = f" JOIN {side}u{i - 1} o USING ({key})" if i else ""
            out += f""",
{side}u{i} AS (SELECT {key}, {u} AS u FROM d{side}{i}{old}),
{side}{i + 1} AS (SELECT {key}, {side} - {rate!r}::DOUBLE * u AS {side} FROM {side}{i} JOIN {side}u{i} USING ({key}))"""
    return f"WITH {out} " + " UNION ALL ".join(
        f"SELECT {i - 1} AS iter, true AS converged, {rd(f'{Q2} * sum(ln(1 + w * (y - a*g) * (y - a*g) / {Q2}))', 4)} AS loss FROM cells JOIN a{i} USING (obj_id) JOIN g{i} USING (feat_id)"
        for i in range(1, steps + 1)
    )


@query(_momentum_sql())
def own_optimiser(spark, sf_dir):
    """Losses of a gradient fit with an optimiser, a start and a stopping rule that are not the library's own choice."""
    rate, beta, steps = _OWN
    fit = Factorizer(
        1, scale=Q, method="sgd", optimiser=Momentum(rate, beta), init=lambda objects, k: _mean_start(objects),
        conv=lambda check: check.n_iter >= steps, check_every=1, max_iter=10,
    )
    m = fit.fit(_objects(spark, sf_dir))
    return tidy(m.history.select("iter", F.lit(m.converged).alias("converged"), "loss"), 4)


@query(f"""WITH {PRICES}, n AS (SELECT count(DISTINCT obj_id) AS a, count(*) AS w FROM cells WHERE obj_id % 7 = 0 AND feat_id = obj_id % {N_MONTHS})
SELECT false AS planted, i AS iter, 0 AS nan_a, 0 AS nan_g, 0 AS nan_w FROM (VALUES (0), (1)) t(i)
UNION ALL SELECT a > 0, 0, a, CASE WHEN a > 0 THEN {N_MONTHS} ELSE 0 END, w FROM n""")
def nan_counts(spark, sf_dir):
    """NaN left in coefficients, basis and weights by each cycle, in a clean table and in one with NaN measured in some cells."""
    objects = _objects(spark, sf_dir)
    begin = _mean_start(objects)
    at = (F.col("obj_id") % N_MONTHS).cast("int")
    hit = (F.col("obj_id") % 7 == 0) & (F.get("w", at) > 0)
    spoilt = F.transform("y", lambda x, i: F.when(hit & (i == at), float("nan")).otherwise(x))
    parts = []
    for planted, rows in ((False, objects), (True, objects.withColumn("y", spoilt))):
        m = Factorizer(1, scale=Q, conv="none", max_iter=2).fit(rows, start=begin)
        parts.append(m.nan_counts.select(F.lit(planted).alias("planted"), "iter", "nan_a", "nan_g", "nan_w"))
    return parts[0].unionByName(parts[1])


@query(f"""WITH RECURSIVE
e AS MATERIALIZED (SELECT vec_id AS obj_id, i::INTEGER AS i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i)),
gram AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM e a JOIN e b USING (obj_id) GROUP BY 1, 2),
{components_sql("gram", 5)},
held AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM ({" UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(5))}) GROUP BY 1, 2),
turned AS (SELECT obj_id, j AS i, sum(x * v) AS t FROM e JOIN held USING (i) GROUP BY 1, 2)
SELECT obj_id, {rd("sqrt(sum(x * t))")} AS kept FROM e JOIN turned USING (obj_id, i) GROUP BY 1""")
def pca_baseline(spark, sf_dir):
    """Principal components of the embeddings: per object the part of its length that five of them keep."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obj_id"), F.col("embedding").cast("array<double>").alias("y"))
    done = baselines.principal_components(rows, 5).project(rows)
    kept = F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x)
    return tidy(done.select("obj_id", F.sqrt(kept).alias("kept")))


@query()
def pursuit_baseline(spark, sf_dir):
    """Low-rank plus sparse split of the prices: per object the size of its sparse part."""
    p = baselines.pursuit(price_objects(spark, sf_dir).select("obj_id", "y"), max_iter=15)
    return p.parts.select("obj_id", F.aggregate("s", F.lit(0.0), lambda t, x: t + F.abs(x)).alias("sparse"))


# Suppliers in overlapping classes by balance: a few may be in two.
def _classes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("obj_id"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"))
    geo = bins.BinGeometry(n=3, x_min=0.0, x_max=9000.0, y_min=0.0, y_max=0.0, x_width_factor=1.6, bump_height=0.0)
    return bins.bin_members(s, bins.bin_table(spark, geo).withColumn("wy", F.lit(1.0))).select("bin", "obj_id")


@query()
def grid_fit(spark, sf_dir):
    """A grid of models for all classes at once: cycles and loss of each."""
    data = _classes(spark, sf_dir).join(price_objects(spark, sf_dir), "obj_id")
    models = population.fit_grid(data, [1, 2], [2.0, 4.0], Settings(tol=1e-3, check_every=2, max_iter=6))
    rows = [(m.model_id, m.spec.grp, m.k, m.n_iter, m.converged, m.loss_history[-1]) for m in models.values()]
    return spark.createDataFrame(rows, "model_id string, bin int, k int, n_iter int, converged boolean, loss double")


@query()
def population_analysis(spark, sf_dir):
    """The whole pipeline over all classes: split, grid, validation, best model, scores, flags."""
    p = population.analyse(
        _classes(spark, sf_dir), price_objects(spark, sf_dir), [1, 2], [2.0, 4.0], threshold=0.7,
        settings=Settings(tol=1e-3, check_every=2, max_iter=6), max_iter=20,
    )
    return p.outliers


_UNIT = "(SELECT sqrt(sum(g * g)) FROM g3)"


@query(f"""WITH {als_sql(3)}, c AS (SELECT s_nationkey, a * {_UNIT} AS a FROM a3 JOIN supplier ON s_suppkey = obj_id)
SELECT s_nationkey, count(*) AS n, {rd("avg(a)", 5)} AS mean, {rd("stddev_pop(a)", 5)} AS std, {rd("min(a)", 5)} AS lo, {rd("max(a)", 5)} AS hi FROM c GROUP BY 1""")
def coefficients_by_class(spark, sf_dir):
    """Coefficients of a rank-one model by the suppliers' nation."""
    _, m = _rank1_fit(spark, sf_dir, 3)
    scale = float(np.sqrt((m.g**2).sum()))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("obj_id"), "s_nationkey")
    rows = m.coeffs.join(s, "obj_id").select("s_nationkey", (F.col("a")[0] * F.lit(scale)).alias("a"))
    return tidy(diagnose.by_class(rows, "a", "s_nationkey"), 5)


@query(f"WITH {als_sql(3)} SELECT feat_id, {rd(f'g / {_UNIT}')} AS g FROM g3")
def fitted_basis(spark, sf_dir):
    """Basis of a rank-one model; the months without data are not in it."""
    _, m = _rank1_fit(spark, sf_dir, 3)
    length = float(np.sqrt((m.g**2).sum()))
    return tidy(m.basis.select("feat_id", (F.col("g")[0] / F.lit(length)).alias("g")).filter("g <> 0"))


@query(f"""WITH {als_sql(3)}, l AS ({" UNION ALL ".join(f"SELECT {i} AS i, {Q2} * sum(ln(1 + w * (y - a*g) * (y - a*g) / {Q2})) AS loss FROM cells JOIN a{i} USING (obj_id) JOIN g{i} USING (feat_id)" for i in (1, 2, 3))})
SELECT n.i - 1 AS iter, {rd("abs(o.loss - n.loss) / abs(n.loss)", 8)} AS change FROM l n JOIN l o ON o.i = n.i - 1""")
def relative_loss_change(spark, sf_dir):
    """Change of the loss from cycle to cycle, which the loss rule compares with its tolerance."""
    _, m = _rank1_fit(spark, sf_dir, 3)
    h = m.loss_history
    rows = [(i, abs(h[i - 1] - h[i]) / abs(h[i])) for i in range(1, len(h))]
    return tidy(spark.createDataFrame(rows, "iter int, change double"), 8)


def flagship(spark, sf_dir):
    """p01 score of every supplier under a rank-one robust fit of its monthly prices, most anomalous first."""
    objects, model = _rank1_fit(spark, sf_dir, 3)
    scored = model.score(objects, scores=("p01", "median"), threshold=0.6)
    return tidy(scored.select("obj_id", "p01", "median", "n_valid", "is_outlier")).orderBy("p01", "obj_id")
