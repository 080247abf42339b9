"""Queries on the price cells: preparation, half steps, weights, scores, metrics, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import measure
from plumbline.functions.losses import Cauchy, Gaussian, Loss, StudentT
from plumbline.functions.scores import CELL_SCORES
from plumbline.operators import axis, cells as ops, diagnose, metrics, prepare
from plumbline.workload.inputs import (
    DENSE, N_MONTHS, PRICES, Q2, RANK1, Rank1, price_cells, price_objects, query, raw_prices, rd, table, tidy, als_sql,
)

CLIP = (6, 5)


@query(f"""WITH {PRICES}
SELECT obj_id, CAST(feat_id - {CLIP[0]} AS INTEGER) AS feat_id, {rd("y")} AS y, {rd("w")} AS w
FROM cells WHERE feat_id BETWEEN {CLIP[0]} AND {N_MONTHS - CLIP[1] - 1}""")
def cells_prepare(spark, sf_dir):
    cells = prepare.prepare_cells(raw_prices(spark, sf_dir).drop("n"))
    return tidy(prepare.clip_cells(cells, N_MONTHS, CLIP))


# Values below 0.05 stand for unreadable ones, lines without discount for an uncertainty of zero.
@query("""WITH m AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.02 THEN NULL ELSE l_extendedprice / 10000.0 END AS y, l_tax AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, """ + rd("CASE WHEN y IS NULL OR s = 0 THEN 0 ELSE y END") + """ AS y,
       """ + rd("CASE WHEN y IS NULL OR s = 0 THEN 0 ELSE 1 / (s * s) END") + """ AS w FROM m""")  # fmt: skip
def missing_rule(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_discount") < 0.02, F.lit(float("nan"))).otherwise(F.col("l_extendedprice") / 10000.0).alias("y"),
        F.col("l_tax").alias("sigma"),
    )
    return tidy(prepare.prepare_cells(rows))


@query(f"""WITH {PRICES}, grid AS (SELECT obj_id, CAST(f AS INTEGER) AS feat_id FROM (SELECT DISTINCT obj_id FROM cells) o, range({N_MONTHS}) t(f))
SELECT obj_id, CAST(feat_id - {CLIP[0]} AS INTEGER) AS feat_id, {rd("coalesce(y, 0)")} AS y, {rd("coalesce(w, 0)")} AS w
FROM grid LEFT JOIN cells USING (obj_id, feat_id) WHERE feat_id BETWEEN {CLIP[0]} AND {N_MONTHS - CLIP[1] - 1}""")
def layouts_round_trip(spark, sf_dir):
    objects = prepare.clip_arrays(price_objects(spark, sf_dir), CLIP)
    return tidy(prepare.objects_to_cells(objects))


@query(f"""WITH {PRICES}, axis AS (SELECT CAST(i AS INTEGER) - 2 AS feat_id, 846.0 + i * (870.0 - 846.0) / {N_MONTHS - 1} AS x FROM range({N_MONTHS}) t(i) WHERE i BETWEEN 2 AND {N_MONTHS - 3}),
clipped AS (SELECT obj_id, feat_id - 2 AS feat_id, y, w FROM cells WHERE feat_id BETWEEN 2 AND {N_MONTHS - 3})
SELECT feat_id, {rd("any_value(x)")} AS x, count(*) AS n, {rd("sum(w * y) / sum(w)")} AS y FROM clipped JOIN axis USING (feat_id) GROUP BY feat_id""")
def feature_axis(spark, sf_dir):
    cells = prepare.clip_cells(prepare.prepare_cells(raw_prices(spark, sf_dir).drop("n")), N_MONTHS, 2)
    means = cells.groupBy("feat_id").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"))
    return tidy(prepare.feature_axis(spark, 846.0, 870.0, N_MONTHS, 2).join(means, "feat_id"))


@query(f"WITH {RANK1} SELECT obj_id, {rd('a')} AS a FROM coeffs")
def a_step_rank1(spark, sf_dir):
    m = Rank1(spark, sf_dir)
    return tidy(m.coeffs.select("obj_id", F.col("a")[0].alias("a")))


@query(f"""WITH {RANK1}
SELECT feat_id, {rd("sum(w * y * a) / sum(w * a * a)")} AS g FROM cells JOIN coeffs USING (obj_id) GROUP BY feat_id""")
def g_step_rank1(spark, sf_dir):
    m = Rank1(spark, sf_dir)
    return tidy(ops.g_step(m.cells, m.coeffs, 1).select("feat_id", F.col("g")[0].alias("g")))


# The second basis vector is a straight line over the months.
RANK2 = RANK1 + f""",
two AS (SELECT feat_id, g AS g1, (feat_id - 41) / 41.0 AS g2 FROM basis),
sums AS (SELECT obj_id, sum(w*g1*g1) + 0.01 AS p, sum(w*g1*g2) AS q, sum(w*g2*g2) + 0.01 AS s, sum(w*y*g1) AS b1, sum(w*y*g2) AS b2
         FROM cells JOIN two USING (feat_id) GROUP BY 1),
coeffs2 AS (SELECT obj_id, (s*b1 - q*b2) / (p*s - q*q) AS a1, (p*b2 - q*b1) / (p*s - q*q) AS a2 FROM sums)"""


def _two(basis):
    return basis.select("feat_id", F.array(F.col("g")[0], (F.col("feat_id") - 41) / 41.0).alias("g"))


@query(f"WITH {RANK2} SELECT obj_id, {rd('a1')} AS a1, {rd('a2')} AS a2 FROM coeffs2")
def a_step_rank2(spark, sf_dir):
    cells = price_cells(spark, sf_dir)
    a = ops.a_step(cells, _two(ops.mean_basis(cells)), 2, ridge=0.01)
    return tidy(a.select("obj_id", F.col("a")[0].alias("a1"), F.col("a")[1].alias("a2")))


@query(f"""WITH {RANK2},
gs AS (SELECT feat_id, sum(w*a1*a1) + 0.01 AS p, sum(w*a1*a2) AS q, sum(w*a2*a2) + 0.01 AS s, sum(w*y*a1) AS b1, sum(w*y*a2) AS b2
       FROM cells JOIN coeffs2 USING (obj_id) GROUP BY 1)
SELECT feat_id, {rd("(s*b1 - q*b2) / (p*s - q*q)")} AS g1, {rd("(p*b2 - q*b1) / (p*s - q*q)")} AS g2 FROM gs""")
def g_step_rank2(spark, sf_dir):
    cells = price_cells(spark, sf_dir)
    a = ops.a_step(cells, _two(ops.mean_basis(cells)), 2, ridge=0.01)
    g = ops.g_step(cells, a, 2, ridge=0.01)
    return tidy(g.select("feat_id", F.col("g")[0].alias("g1"), F.col("g")[1].alias("g2")))


@query(f"WITH {RANK1} SELECT obj_id, feat_id, {rd('pred')} AS pred FROM resid")
def reconstruction(spark, sf_dir):
    return tidy(Rank1(spark, sf_dir).residuals.select("obj_id", "feat_id", "pred"))


@query(f"WITH {RANK1} SELECT obj_id, feat_id, {rd('y')} AS y, {rd('r')} AS r FROM resid")
def residuals(spark, sf_dir):
    return tidy(Rank1(spark, sf_dir).residuals.select("obj_id", "feat_id", "y", "r"))


@query(f"""WITH {RANK1}
SELECT obj_id, feat_id, {rd("4*2.25 / (4*2.25 + w*r*r)")} AS student, {rd("w_rob")} AS cauchy, 1.0::DOUBLE AS gaussian, {rd("w_tot")} AS total FROM weighted""")
def robust_weights(spark, sf_dir):
    m = Rank1(spark, sf_dir)
    w, r = F.col("w"), F.col("r")
    return tidy(m.weighted.select(
        "obj_id", "feat_id", StudentT(4.0, 1.5).weight(w, r).alias("student"), F.col("w_rob").alias("cauchy"),
        Gaussian().weight(w, r).alias("gaussian"), F.col("w_tot").alias("total"),
    ))


@query(f"""WITH {RANK1}
SELECT obj_id, feat_id, {rd("z")} AS z, {rd("r / (w_rob * w_rob)")} AS shown, w_rob < 0.5 AS is_outlier FROM weighted""")
def z_scores(spark, sf_dir):
    m = Rank1(spark, sf_dir).weighted
    shown = measure.display_residual(F.col("r"), F.col("w_rob"))
    return tidy(m.select("obj_id", "feat_id", "z", shown.alias("shown"), (F.col("w_rob") < 0.5).alias("is_outlier")))


@query(f"""WITH {RANK1} SELECT {rd("sum(w*r*r)", 4)} AS gaussian, {rd(f"{Q2} * sum(ln(1 + w*r*r / {Q2}))", 4)} AS cauchy,
{rd("9.0 * sum(ln(1 + w*r*r / 9.0))", 4)} AS student FROM resid""")
def losses(spark, sf_dir):
    m = Rank1(spark, sf_dir).residuals
    kinds = {"gaussian": Gaussian(), "cauchy": Cauchy(3.0), "student": StudentT(4.0, 1.5)}
    return tidy(m.agg(*[F.sum(k.loss(F.col("w"), F.col("r"))).alias(n) for n, k in kinds.items()]), 4)


class Welsch(Loss):
    """A loss of the user's own: weights that fall off exponentially."""

    def weight(self, w, r):
        return F.exp(-w * r * r / (2.0 * Q2))

    def loss(self, w, r):
        return F.lit(2.0 * Q2) * (F.lit(1.0) - F.exp(-w * r * r / (2.0 * Q2)))


@query(f"""WITH {RANK1} SELECT obj_id, {rd(f"sum(2.0*{Q2} * (1 - exp(-w*r*r / (2.0*{Q2}))))", 4)} AS loss,
{rd(f"1 - avg(CASE WHEN exp(-w*r*r / (2.0*{Q2})) < 0.8 THEN 1.0 ELSE 0.0 END)")} AS score FROM resid GROUP BY obj_id""")
def user_loss_and_score(spark, sf_dir):
    m = ops.with_weights(Rank1(spark, sf_dir).residuals, Welsch())
    score = lambda w: F.lit(1.0) - F.avg((w < 0.8).cast("double"))
    scores = ops.object_scores(m, {"score": score}).select("obj_id", F.round("score", 6).alias("score"))
    return ops.total_loss(m, Welsch(), ("obj_id",)).select("obj_id", F.round("loss", 4).alias("loss")).join(scores, "obj_id")


_SCORES_SQL = f"""obj_id, {rd("median(w_rob)")} AS median, {rd("quantile_cont(w_rob, 0.01)")} AS p01, {rd("quantile_cont(w_rob, 0.10)")} AS p10,
{rd("avg(w_rob)")} AS mean, {rd("min(w_rob)")} AS "min", {rd("avg(CASE WHEN w_rob < 0.5 THEN 1.0 ELSE 0.0 END)")} AS frac_low,
{rd("1 - avg(CASE WHEN w_rob < 0.5 THEN 1.0 ELSE 0.0 END)")} AS frac_ok, count(*) FILTER (WHERE w_rob < 0.3) AS n_low,
-count(*) FILTER (WHERE w_rob < 0.3) AS neg_n_low, count(*) FILTER (WHERE w > 0) AS n_valid"""


@query(f"WITH {DENSE} SELECT {_SCORES_SQL} FROM dense GROUP BY obj_id")
def object_scores(spark, sf_dir):
    m = Rank1(spark, sf_dir, dense=True)
    return tidy(ops.object_scores(m.weighted, CELL_SCORES))


@query(f"WITH {DENSE} SELECT {_SCORES_SQL} FROM dense WHERE w > 0 GROUP BY obj_id")
def object_scores_present(spark, sf_dir):
    m = Rank1(spark, sf_dir, dense=True)
    return tidy(ops.object_scores(m.weighted, CELL_SCORES, missing="skip"))


@query(f"""WITH {DENSE}, s AS (SELECT obj_id, quantile_cont(w_rob, 0.01) AS p01, median(w_rob) AS median FROM dense GROUP BY 1)
SELECT obj_id, {rd("p01")} AS p01, p01 < 0.7 AS low_p01, median < 0.9 AS low_median FROM s""")
def outlier_flags(spark, sf_dir):
    m = Rank1(spark, sf_dir, dense=True)
    s = ops.object_scores(m.weighted, {n: CELL_SCORES[n] for n in ("p01", "median")})
    return tidy(s.select("obj_id", "p01", (F.col("p01") < 0.7).alias("low_p01"), (F.col("median") < 0.9).alias("low_median")))


@query(f"WITH {RANK1} SELECT obj_id, {rd('median(w_rob)')} AS median, count(*) AS n_valid FROM weighted WHERE feat_id BETWEEN 24 AND 47 GROUP BY obj_id")
def score_in_feature_range(spark, sf_dir):
    m = Rank1(spark, sf_dir).weighted.filter(F.col("feat_id").between(24, 47))
    return tidy(ops.object_scores(m, {"median": CELL_SCORES["median"]}))


# --- calibration over a small grid of scales ------------------------------------------------------

QS = [0.5, 1.0, 2.0, 3.0, 5.0]
_ZQ = "r * sqrt(w) * sqrt(q*q / (q*q + w*r*r))"
_CV = f""", zs AS (SELECT q, w, r, {_ZQ} AS z FROM dense, (VALUES {", ".join(f"({q}::DOUBLE)" for q in QS)}) t(q)),
cv AS (SELECT q, stddev_pop(z) AS std_z, avg(w*r*r) AS chi2_red, sqrt(avg(w*r*r)) AS rmse, median(abs(z)) AS mad_z,
              -ln(stddev_pop(z)) + (stddev_pop(z)**2 + avg(z)**2) / 2 - 0.5 AS kl FROM zs GROUP BY q)"""


def _grid_cells(spark, sf_dir, dense=True):
    m = Rank1(spark, sf_dir, dense).residuals.withColumn("q", F.explode(F.array(*[F.lit(q) for q in QS])))
    robust = F.col("q") * F.col("q") / (F.col("q") * F.col("q") + F.col("w") * F.col("r") * F.col("r"))
    return m.withColumn("z", measure.z_score(F.col("r"), F.col("w"), robust))


@query(f"WITH {DENSE} {_CV} SELECT q, {rd('std_z')} AS std_z, {rd('chi2_red')} AS chi2_red, {rd('rmse')} AS rmse, {rd('mad_z')} AS mad_z, {rd('kl')} AS kl FROM cv")
def cv_metrics(spark, sf_dir):
    return tidy(metrics.calibration(_grid_cells(spark, sf_dir), ("q",)))


@query(f"""WITH {DENSE} {_CV.replace("FROM dense", "FROM (SELECT * FROM dense WHERE w > 0)")}
SELECT q, {rd('std_z')} AS std_z, {rd('chi2_red')} AS chi2_red, {rd('rmse')} AS rmse, {rd('mad_z')} AS mad_z, {rd('kl')} AS kl FROM cv""")
def cv_metrics_present(spark, sf_dir):
    return tidy(metrics.calibration(_grid_cells(spark, sf_dir), ("q",), missing="skip"))


_LONG = """, long AS (
  SELECT 0 AS bin, 1 AS k, q, 'std_z' AS metric, std_z AS value, abs(std_z - 1) AS deviation FROM cv
  UNION ALL SELECT 0, 1, q, 'chi2_red', chi2_red, abs(chi2_red - 1) FROM cv
  UNION ALL SELECT 0, 1, q, 'rmse', rmse, rmse FROM cv
  UNION ALL SELECT 0, 1, q, 'mad_z', mad_z, abs(mad_z - 0.6745) FROM cv)"""


def _long(spark, sf_dir):
    wide = metrics.calibration(_grid_cells(spark, sf_dir), ("q",)).withColumns({"bin": F.lit(0), "k": F.lit(1)})
    return metrics.long_scores(wide, ("bin", "k", "q"))


# the metric that does not depend on q ties; rounding makes the tie exact in both engines
@query(f"""WITH {DENSE} {_CV} {_LONG}, ranked AS (SELECT *, row_number() OVER (PARTITION BY bin, metric ORDER BY round(deviation, 9), k, q) AS rn FROM long)
SELECT bin, metric, k AS best_k, q AS best_q, {rd("value")} AS value, {rd("deviation")} AS deviation FROM ranked WHERE rn = 1""")
def best_model(spark, sf_dir):
    scores = _long(spark, sf_dir).withColumn("value", F.round("value", 9))
    return tidy(metrics.best_models(scores))


@query(f"""WITH {DENSE} {_CV} {_LONG}
SELECT bin, k, q, metric, {rd("CASE WHEN metric = 'rmse' THEN deviation ELSE ln(deviation + 1e-10) END", 5)} AS deviation FROM long""")
def metric_deviations(spark, sf_dir):
    dev = measure.metric_deviation(F.col("metric"), F.col("value"), log=True)
    return tidy(_long(spark, sf_dir).select("bin", "k", "q", "metric", dev.alias("deviation")), 5)


# --- diagnostics ----------------------------------------------------------------------------------


@query(f"""WITH {RANK1} SELECT feat_id, {rd("sqrt(avg(r*r))")} AS rms, count(*) AS n, {rd("median(r)")} AS median,
{rd("quantile_cont(r, 0.16)")} AS p16, {rd("quantile_cont(r, 0.84)")} AS p84 FROM resid GROUP BY feat_id""")
def residual_summary(spark, sf_dir):
    return tidy(diagnose.residual_summary(Rank1(spark, sf_dir).residuals))


_HIST = """SELECT f.{g} AS {g}, f.cell, {edge} AS edge, coalesce(c.n, 0) AS n, {density} AS density
FROM (SELECT {g}, sum(n) AS total, unnest(range(25))::INTEGER AS cell FROM c GROUP BY {g}) f LEFT JOIN c ON f.{g} = c.{g} AND f.cell = c.cell"""


@query(f"""WITH {RANK1}, c AS (SELECT feat_id % 2 AS grp, least(floor(w_rob / 0.04::DOUBLE), 24)::INTEGER AS cell, count(*) AS n FROM weighted GROUP BY 1, 2)
{_HIST.format(g="grp", edge=rd("f.cell * 0.04::DOUBLE"), density=rd("coalesce(c.n, 0) / (f.total * 0.04::DOUBLE)"))}""")
def weight_histogram(spark, sf_dir):
    m = Rank1(spark, sf_dir).weighted.withColumn("grp", F.col("feat_id") % 2)
    return tidy(diagnose.histogram(m, "w_rob", 0.0, 1.0, 25, ("grp",)))


@query(f"""WITH {RANK1}, n AS (SELECT obj_id, stddev_pop(y) AS noise FROM cells GROUP BY 1), c AS (SELECT quantile_cont(noise, 0.9) AS cut FROM n)
SELECT obj_id, {rd("noise")} AS noise, {rd("cut")} AS cut, noise < cut AS low_noise FROM n, c""")
def noise_level(spark, sf_dir):
    return tidy(diagnose.low_noise(price_cells(spark, sf_dir)))


_PROBS = [0.01, 0.05, 0.25, 0.5]


def _expected(p: float) -> float:
    from statistics import NormalDist

    return Q2 / (Q2 + NormalDist().inv_cdf(p) ** 2)


@query(f"WITH {RANK1} " + " UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS p, {rd(repr(_expected(p)) + '::DOUBLE')} AS expected, {rd(f'quantile_cont(w_rob, {p})')} AS observed FROM weighted" for p in _PROBS
))
def weight_quantiles(spark, sf_dir):
    return tidy(diagnose.weight_quantiles(Rank1(spark, sf_dir).weighted, 3.0, _PROBS))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE o IS NULL) AS o_null, 0::BIGINT AS o_nan, 0::BIGINT AS o_inf,
count(*) FILTER (WHERE q IS NULL) AS q_null, count(*) FILTER (WHERE q IS NOT NULL AND l_discount = 0) AS q_nan, 0::BIGINT AS q_inf
FROM (SELECT CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS o, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS q, l_discount FROM lineitem)""")
def quality_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("o"),
        F.when(F.col("l_quantity") <= 45, F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))).alias("q"),
    )
    return prepare.quality_counts(rows, "o", "q")


@query("SELECT i AS k, j AS l, " + rd("sum(embedding[i+1]::DOUBLE * embedding[j+1]::DOUBLE)") + """ AS value
FROM embeddings, (SELECT a::INTEGER AS i, b::INTEGER AS j FROM range(64) x(a), range(64) y(b) WHERE a <= b) GROUP BY 1, 2""")
def gram_matrix(spark, sf_dir):
    """Gram matrix of all 64 coefficients."""
    return tidy(ops.gram(table(spark, sf_dir, "embeddings"), "embedding", 64))


_AFTER = als_sql(2, robust=True)


@query(f"""WITH {_AFTER}
SELECT {rd("(SELECT max((n.g - o.g)**2) / avg(n.g * n.g) FROM g1 o JOIN g2 n USING (feat_id))")} AS frac_g,
       {rd("(SELECT max((n.a - o.a)**2) / avg(n.a * n.a) FROM a1 o JOIN a2 n USING (obj_id))")} AS frac_a""")
def convergence_change(spark, sf_dir):
    cells = price_cells(spark, sf_dir)
    loss = Cauchy(3.0)
    g = ops.mean_basis(cells)
    a = cells.select("obj_id").distinct().withColumn("a", F.array(F.lit(1.0)))
    steps = []
    for _ in range(2):
        weighted = ops.with_weights(ops.with_prediction(cells, a, g, 1), loss)
        a = ops.a_step(weighted, g, 1, weight="w_tot")
        g = ops.g_step(weighted, a, 1, weight="w_tot")
        steps.append((a, g))
    (a1, g1), (a2, g2) = steps
    out = ops.max_frac_change(g1, g2, "feat_id", "g", 1).select(F.col("max_frac").alias("frac_g"))
    return tidy(out.withColumn("frac_a", ops.max_frac_change(a1, a2, "obj_id", "a", 1).scalar()))


@query(f"""WITH {RANK1}, p AS (SELECT *, -2 * w_tot * r AS pull FROM weighted)
SELECT 'A' AS side, obj_id AS id, {rd("sum(pull * g)", 5)} AS gradient FROM p JOIN basis USING (feat_id) GROUP BY 2
UNION ALL SELECT 'G', feat_id::BIGINT, {rd("sum(pull * a)", 5)} FROM p JOIN coeffs USING (obj_id) GROUP BY 2""")
def loss_gradient(spark, sf_dir):
    m = Rank1(spark, sf_dir)
    da, dg = ops.gradients(m.cells, m.coeffs, m.basis, m.loss, 1)
    rows = da.select(F.lit("A").alias("side"), F.col("obj_id").alias("id"), F.col("da")[0].alias("gradient"))
    other = dg.select(F.lit("G").alias("side"), F.col("feat_id").cast("bigint").alias("id"), F.col("dg")[0].alias("gradient"))
    return tidy(rows.unionByName(other), 5)


# --- along the axis -------------------------------------------------------------------------------


@query("""WITH spots AS (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS x, count(*) AS n FROM events GROUP BY 1, 2),
gaps AS (SELECT *, x - lag(x) OVER (PARTITION BY user_id ORDER BY x) AS gap FROM spots),
step AS (SELECT user_id, median(gap) AS step FROM gaps GROUP BY 1),
marked AS (SELECT user_id, x, n, sum(CASE WHEN gap > 3.0 * step THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY x) AS chunk FROM gaps JOIN step USING (user_id))
SELECT user_id, chunk::BIGINT AS chunk, """ + rd("min(x)") + " AS x_start, " + rd("max(x)") + " AS x_end, sum(n)::BIGINT AS n FROM marked GROUP BY 1, 2")  # fmt: skip
def gap_chunks(spark, sf_dir):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    events = table(spark, sf_dir, "events").select("user_id", (micros / 1e6).alias("x"))
    return tidy(axis.gap_chunks(events, "x", ("user_id",), slice_width=86400.0 * 7))


@query(f"""WITH {RANK1},
s AS (SELECT obj_id, feat_id, w_rob, avg(w_rob) OVER (PARTITION BY obj_id ORDER BY feat_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM weighted),
low AS (SELECT *, feat_id - row_number() OVER (PARTITION BY obj_id ORDER BY feat_id) AS island FROM s WHERE m < 0.9),
runs AS (SELECT obj_id, island, min(feat_id) AS feat_start, max(feat_id) AS feat_end, count(*) AS n, avg(w_rob) AS mw FROM low GROUP BY 1, 2)
SELECT obj_id, feat_start, feat_end, n, {rd("mw")} AS mean_weight, (row_number() OVER (PARTITION BY obj_id ORDER BY feat_start) - 1)::INTEGER AS run FROM runs""")
def low_weight_runs(spark, sf_dir):
    return tidy(axis.low_weight_runs(Rank1(spark, sf_dir).weighted, 2, 0.9))



@query("""WITH known AS (SELECT p_size * 1.6::DOUBLE AS x, count(*) AS lines FROM part GROUP BY 1),
segs AS (SELECT user_id, event_type, min(value) AS seg_start, max(value) AS seg_end FROM events GROUP BY 1, 2)
SELECT user_id, event_type, lines, """ + rd("x") + """ AS x FROM segs JOIN known ON x + 0.25::DOUBLE >= seg_start AND x - 0.25::DOUBLE <= seg_end""")  # fmt: skip
def range_match_lines(spark, sf_dir):
    """The places of known lines that each user's range of values touches, with the number of lines there."""
    known = table(spark, sf_dir, "part").groupBy((F.col("p_size") * 1.6).alias("x")).agg(F.count(F.lit(1)).alias("lines"))
    segs = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("value").alias("seg_start"), F.max("value").alias("seg_end"))
    hits = axis.match_ranges(segs, known, grid=16.0, margin=0.25)
    return tidy(hits.select("user_id", "event_type", "lines", "x"))


@query(f"""WITH {RANK1},
s AS (SELECT obj_id, feat_id, avg(w_rob) OVER (PARTITION BY obj_id ORDER BY feat_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM weighted),
low AS (SELECT *, feat_id - row_number() OVER (PARTITION BY obj_id ORDER BY feat_id) AS island FROM s WHERE m < 0.9),
segs AS (SELECT obj_id, min(feat_id) AS feat_start, max(feat_id) AS feat_end FROM low GROUP BY obj_id, island),
known AS (SELECT DISTINCT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS x FROM orders WHERE o_totalprice > 400000)
SELECT obj_id, feat_start, feat_end, x::INTEGER AS x FROM segs JOIN known ON x BETWEEN feat_start AND feat_end""")
def anomalous_months(spark, sf_dir):
    """Low-weight stretches matched with the months that had a very large order."""
    runs = axis.low_weight_runs(Rank1(spark, sf_dir).weighted, 2, 0.9)
    segs = runs.withColumns({"seg_start": F.col("feat_start").cast("double"), "seg_end": F.col("feat_end").cast("double")})
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000")
    known = big.select(((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("double").alias("x")).distinct()
    return axis.match_ranges(segs, known, grid=6.0).select("obj_id", "feat_start", "feat_end", F.col("x").cast("int").alias("x"))


@query("""WITH b AS (SELECT p_partkey AS band, p_retailprice AS lo, p_retailprice + p_size / 10.0 AS hi, p_type AS species FROM part)
SELECT 'line' AS kind, band AS id FROM b WHERE lo BETWEEN 910.05 AND 960.05 AND species IN ('ECONOMY', 'SMALL')
UNION ALL SELECT 'band', band FROM b WHERE hi >= 910.05 AND lo <= 960.05""")
def lines_in_range(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lines = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("species"), F.col("p_retailprice").alias("x"))
    bands = part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x_start"), (F.col("p_retailprice") + F.col("p_size") / 10.0).alias("x_end"))
    hit = axis.in_range(lines, 910.05, 960.05, ["ECONOMY", "SMALL"]).select(F.lit("line").alias("kind"), "id")
    return hit.unionByName(axis.clip_bands(bands, 910.05, 960.05).select(F.lit("band").alias("kind"), "id"))


@query("""WITH spots AS (SELECT p_retailprice AS x, min((p_size, p_partkey)) AS rk FROM part GROUP BY 1),
kept AS (SELECT list_reduce(list([x] ORDER BY rk), lambda acc, e: CASE WHEN list_has_any([true], list_transform(acc, lambda v: abs(v - e[1]) < 0.25)) THEN acc ELSE list_concat(acc, e) END) AS xs FROM spots)
SELECT p_size AS list_no, p_partkey AS pos, x FROM spots JOIN (SELECT unnest(xs) AS x FROM kept) USING (x) JOIN part ON p_retailprice = x AND (p_size, p_partkey) = rk""")
def dedupe_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.col("p_size").alias("list_no"), F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("x"))
    return axis.dedupe_lines(lines, 0.25)


def _vacuum(x: str) -> str:
    out = x
    return f"WITH {_VACUUM} SELECT p_partkey, {rd('vac')} AS {out}, round(vac, 3) AS rounded FROM v10"


_VACUUM = "v0 AS (SELECT p_partkey, p_retailprice AS air, p_retailprice AS vac FROM part)"
for _i in range(1, 11):
    _S2 = "(1000.0 / vac) ** 2"
    _VACUUM += f", v{_i} AS (SELECT p_partkey, air, air * (1 + (8342.54 + 2406147.0 / (130.0 - {_S2}) + 15998.0 / (38.9 - {_S2})) * 1e-8) AS vac FROM v{_i - 1})"


@query(_vacuum("vacuum"))
def air_to_vacuum(spark, sf_dir):
    x = F.col("p_retailprice")
    part = table(spark, sf_dir, "part")
    return tidy(part.select("p_partkey", measure.air_to_vacuum(x).alias("vacuum"), measure.air_to_vacuum(x, 3).alias("rounded")))


@query(f"""WITH {_VACUUM}, t AS (SELECT *, length(split_part(air::VARCHAR, '.', 2)) AS d FROM v10)
SELECT p_partkey, d::INTEGER AS decimals, CASE d WHEN 1 THEN printf('%.1f', vac) ELSE printf('%.2f', vac) END AS vacuum FROM t""")
def air_to_vacuum_written(spark, sf_dir):
    """Wavelengths as texts, each converted to as many decimals as it is written with."""
    written = F.col("p_retailprice").cast("string")
    decimals = F.length(F.split(written, "[.]")[1]).alias("decimals")
    return table(spark, sf_dir, "part").select("p_partkey", decimals, measure.air_to_vacuum_text(written).alias("vacuum"))
