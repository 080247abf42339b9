"""What the registered queries run on, derived by Spark from the given tables, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.losses import Cauchy
from plumbline.operators import bins, cells as ops, prepare
from plumbline.runtime import checkpointed, laid_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Months from January 1995 to December 2001: the feature axis of the price cells.
N_MONTHS = 84
# Prices are counted in this unit; a prime, so that means do not end in a rounding tie.
UNIT = 9973.0
# Outlier scale of the price models, and its square.
Q = 3.0
Q2 = 9.0


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and -0 made 0, so that results compare across engines."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


def rd(expr: str, digits: int = 6) -> str:
    """The same rounding as SQL."""
    return f"(round({expr}, {digits}) + 0.0)"


# --- supplier x month prices -------------------------------------------------------------------


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obj_id, feat_id, y, n, sigma): mean price of a supplier's lines of a month, and its error
    from the variance pooled over all cells. Sums are partial before the shuffle.

    The cells are written once, laid out by object, and the pooled variance is read off them: the
    lines are scanned once.
    """
    price = F.col("l_extendedprice") / UNIT
    raw = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("obj_id"),
            ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("feat_id"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.avg(price).alias("y"), F.var_pop(price).alias("v"))
    )
    cells = laid_out(raw, ["obj_id"])
    pooled = cells.agg((F.sum(F.col("v") * F.col("n")) / F.sum(F.col("n") - 1)).alias("v")).first()["v"]
    return cells.withColumn("sigma", F.sqrt(F.lit(pooled) / F.col("n"))).drop("v")


def price_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present cells (obj_id, feat_id, y, w)."""
    return prepare.prepare_cells(raw_prices(spark, sf_dir).drop("n"))


def price_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as arrays; gathered without a shuffle, for the cells lie by object."""
    return prepare.cells_to_objects(price_cells(spark, sf_dir), N_MONTHS)


PRICES = f"""
raw AS (
  SELECT l_suppkey AS obj_id, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS feat_id,
         count(*) AS n, avg(l_extendedprice / {UNIT}) AS y, var_pop(l_extendedprice / {UNIT}) * count(*) AS ss
  FROM lineitem GROUP BY 1, 2),
pool AS (SELECT sum(ss) / sum(n - 1) AS v FROM raw),
cells AS (SELECT obj_id, feat_id, y, n / (SELECT v FROM pool) AS w FROM raw)"""


class Rank1:
    """The one-step rank-one model of the prices: weighted mean as basis, least squares for the rest."""

    def __init__(self, spark: SparkSession, sf_dir: str, dense: bool = False):
        self.loss = Cauchy(Q)
        self.cells = price_cells(spark, sf_dir)
        self.basis = ops.mean_basis(self.cells)
        self.coeffs = ops.a_step(self.cells, self.basis, 1)
        rows = self.cells
        if dense:
            rows = prepare.objects_to_cells(prepare.cells_to_objects(rows, N_MONTHS))
        self.residuals = ops.with_prediction(rows, self.coeffs, self.basis, 1)
        self.weighted = ops.with_weights(self.residuals, self.loss)


RANK1 = (
    PRICES
    + f""",
basis AS (SELECT feat_id, sum(w * y) / sum(w) AS g FROM cells GROUP BY 1),
coeffs AS (SELECT obj_id, sum(w * y * g) / sum(w * g * g) AS a FROM cells JOIN basis USING (feat_id) GROUP BY 1),
resid AS (SELECT obj_id, feat_id, y, w, a * g AS pred, y - a * g AS r
          FROM cells JOIN basis USING (feat_id) JOIN coeffs USING (obj_id)),
weighted AS (SELECT *, {Q2} / ({Q2} + w * r * r) AS w_rob, w * {Q2} / ({Q2} + w * r * r) AS w_tot,
                    r * sqrt(w) * sqrt({Q2} / ({Q2} + w * r * r)) AS z FROM resid)"""
)

DENSE = (
    RANK1
    + f""",
grid AS (SELECT obj_id, CAST(f AS INTEGER) AS feat_id FROM (SELECT DISTINCT obj_id FROM cells) o, range({N_MONTHS}) t(f)),
dense AS (SELECT obj_id, feat_id, coalesce(weighted.w, 0) AS w, coalesce(weighted.y, 0) AS y,
                 coalesce(weighted.r, 0) AS r, coalesce(weighted.z, 0) AS z, coalesce(weighted.w_rob, 1) AS w_rob
          FROM grid LEFT JOIN weighted USING (obj_id, feat_id))"""
)


def basis_array(basis: DataFrame, n_features: int, k: int) -> np.ndarray:
    """A basis table as a matrix; a feature that is not in it gets zeros, one outside the axis is an error."""
    g = np.zeros((n_features, k))
    rows = basis.limit(n_features + 1).collect()
    if len(rows) > n_features:
        raise ValueError(f"the basis has more than {n_features} features")
    for r in rows:
        g[r["feat_id"]] = r["g"]
    return g


def als_sql(steps: int, robust: bool = True, each: bool = False, start: bool = True) -> str:
    """Rank-one alternating steps written out as tables a1, g1, a2, g2, ...; a0 is 1 and g0 the weighted mean."""
    f = f"{Q2} / ({Q2} + w * (y - a * g) * (y - a * g))" if robust else "1.0"
    out = PRICES
    if start:
        out += """,
g0 AS (SELECT feat_id, sum(w * y) / sum(w) AS g FROM cells GROUP BY 1),
a0 AS (SELECT obj_id, 1.0 AS a FROM cells GROUP BY 1)"""
    for i in range(1, steps + 1):
        p = i - 1

        def weights(name: str, a: str) -> str:
            return f"""
{name} AS (SELECT obj_id, feat_id, y, w * {f} AS w FROM cells JOIN {a} USING (obj_id) JOIN g{p} USING (feat_id))"""

        out += f""",{weights(f"wt{i}", f"a{p}")},
a{i} AS (SELECT obj_id, sum(w * y * g) / sum(w * g * g) AS a FROM wt{i} JOIN g{p} USING (feat_id) GROUP BY 1)"""
        if each:
            out += "," + weights(f"wu{i}", f"a{i}")
        out += f""",
g{i} AS (SELECT feat_id, sum(w * y * a) / sum(w * a * a) AS g FROM {"wu" if each else "wt"}{i} JOIN a{i} USING (obj_id) GROUP BY 1)"""
    return out


# --- customers on two axes ------------------------------------------------------------------------

GEOMETRY = bins.BinGeometry(
    n=8, x_min=-500.0, x_max=9500.0, y_min=1.5, y_max=3.5, x_width_factor=2.2, y_width_factor=9.0,
    bump_centre=4500.0, bump_sigma=3000.0, bump_height=0.3,
)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obj_id, x, y): a customer's balance and order total, in units near a million."""
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("obj_id")).agg((F.sum("o_totalprice") / (100 * UNIT)).alias("y"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("obj_id"), F.col("c_acctbal").alias("x"))
    return c.join(totals, "obj_id").select("obj_id", "x", "y")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.bin_members(customers(spark, sf_dir), bins.bin_table(spark, GEOMETRY))


def ellipse_terms() -> tuple:
    dx = (F.col("x") - F.col("cx")) / (F.col("wx") / 2)
    dy = (F.col("y") - F.col("cy")) / (F.col("wy") / 2)
    return dx * dx, dy * dy


def member_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bin, obj_id, x, y, score, sx, sy): scores that fall from 1 at a bin's centre to 1/2 at its edge."""
    m = members(spark, sf_dir).join(F.broadcast(bins.bin_table(spark, GEOMETRY)), "bin")
    dx, dy = ellipse_terms()
    one = F.lit(1.0)
    return m.select("bin", "obj_id", "x", "y", (one / (one + dx + dy)).alias("score"), (one / (one + dx)).alias("sx"), (one / (one + dy)).alias("sy"))


_G = GEOMETRY
MEMBERS = f"""
customers AS (
  SELECT c_custkey AS obj_id, c_acctbal AS x, t AS y
  FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) / {100 * UNIT} AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey),
centres AS (
  SELECT CAST(i AS INTEGER) AS bin, {_G.x_min} + i / {_G.n - 1}.0 * {_G.x_max - _G.x_min} AS cx,
         {_G.y_min} + i / {_G.n - 1}.0 * {_G.y_max - _G.y_min} AS base FROM range({_G.n}) t(i)),
bins AS (
  SELECT bin, cx, base + {_G.bump_height} * exp(-0.5 * ((cx - {_G.bump_centre}) / {_G.bump_sigma}) ** 2) AS cy,
         {_G.x_width!r} AS wx, {_G.y_width!r} AS wy FROM centres),
pairs AS (
  SELECT bin, obj_id, x, y, ((x - cx) / (wx / 2)) ** 2 AS dx, ((y - cy) / (wy / 2)) ** 2 AS dy FROM customers, bins),
members AS (
  SELECT bin, obj_id, x, y, 1 / (1 + dx + dy) AS score, 1 / (1 + dx) AS sx, 1 / (1 + dy) AS sy FROM pairs WHERE dx + dy < 1)"""

# A member is flagged below this score.
LOW = 0.6


def flagged(scores: DataFrame, column: str = "score", threshold: float = LOW) -> DataFrame:
    return scores.filter(F.col(column) < threshold).select("bin", "obj_id", F.col(column).alias("score"))


# Selection metrics and the score each one flags by.
METRIC_SCORES = {"std_z": "score", "mad_z": "sx", "rmse": "sy"}


def metric_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = checkpointed(member_scores(spark, sf_dir))
    out = None
    for metric, column in METRIC_SCORES.items():
        part = flagged(scores, column, 0.75).withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    return out


METRIC_OUTLIERS = MEMBERS + ",\nflags AS (" + "\nUNION ALL ".join(
    f"SELECT bin, obj_id, {c} AS score, '{m}' AS metric FROM members WHERE {c} < 0.75" for m, c in METRIC_SCORES.items()
) + ")"


def unit(seed: str, *keys: str) -> str:
    """A hash draw in [0, 1) as SQL."""
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"


def components_sql(matrix: str, n: int, squarings: int = 34) -> str:
    """The n leading components of a symmetric table (i, j, v) as tables p0, p1, ... (i, j, v) and l0, l1, ... (v).

    A matrix squared again and again, its trace held at 1, becomes the projector on its leading direction; that
    direction is then taken out and the next one found in the same way.
    """
    out = []
    for c in range(n):
        if c:
            out.append(f"m{c} AS MATERIALIZED (SELECT i, j, m.v - l{c - 1}.v * p.v AS v FROM m{c - 1} m JOIN p{c - 1} p USING (i, j), l{c - 1})")
        else:
            out.append(f"m0 AS MATERIALIZED (SELECT i, j, v FROM {matrix})")
        out.append(f"""q{c}(s, i, j, v) AS (
  SELECT 0, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM m{c}
  UNION ALL
  SELECT s + 1, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM (
    SELECT a.s, a.i, b.j, sum(a.v * b.v) AS v FROM q{c} a JOIN q{c} b ON a.j = b.i AND a.s = b.s WHERE a.s < {squarings} GROUP BY 1, 2, 3)),
p{c} AS MATERIALIZED (SELECT i, j, v FROM q{c} WHERE s = {squarings}),
l{c} AS MATERIALIZED (SELECT sum(m.v * p.v) AS v FROM m{c} m JOIN p{c} p USING (i, j))""")
    return ",\n".join(out)
