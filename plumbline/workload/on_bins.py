"""Queries on the customers in overlapping bins: membership, picks, cross-bin verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import measure
from plumbline.operators import bins, crossbin, diagnose
from plumbline.plans.baselines import embed
from plumbline.sources import store
from plumbline.workload.inputs import (
    GEOMETRY, LOW, MEMBERS, METRIC_OUTLIERS, METRIC_SCORES, customers, flagged, member_scores, members, metric_outliers, query, rd, table, tidy, unit,
)
from plumbline.runtime import checkpointed, scratch_path


@query("""SELECT c_custkey AS obj_id, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey""")
def catalogue_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("obj_id"), "o_orderkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("obj_id"), "c_name")
    return store.match_catalogue(orders, c).select("obj_id", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey AS obj_id, " + rd("c_nationkey + 5 * log10((c_acctbal + 1000) / 1000) + 5") + " AS m FROM customer")
def absolute_magnitude(spark, sf_dir):
    m = measure.absolute_magnitude(F.col("c_nationkey").cast("double"), F.col("c_acctbal") + 1000)
    return tidy(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("obj_id"), m.alias("m")))


# Bin centres and widths over the range the data take up.
@query(f"""WITH {MEMBERS}, r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM customers)
SELECT i::INTEGER AS bin, {rd("x0 + i / 13.0::DOUBLE * (x1 - x0)")} AS cx,
{rd("y0 + i / 13.0::DOUBLE * (y1 - y0) + 1.5 * exp(-0.5 * ((x0 + i / 13.0::DOUBLE * (x1 - x0) - 4500) / 2000.0::DOUBLE) ** 2)")} AS cy,
{rd("(x1 - x0) / 13 * 1.5")} AS wx, {rd("(y1 - y0) / 13 * 2.8")} AS wy FROM range(14) t(i), r""")
def bin_geometry(spark, sf_dir):
    c = customers(spark, sf_dir)
    r = c.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    geo = bins.BinGeometry(x_min=r["x0"], x_max=r["x1"], y_min=r["y0"], y_max=r["y1"], bump_centre=4500.0, bump_sigma=2000.0)
    return tidy(bins.bin_table(spark, geo))


@query(f"WITH {MEMBERS} SELECT bin, obj_id, {rd('x')} AS x, {rd('y')} AS y, {rd('score')} AS score FROM members")
def ellipse_bins(spark, sf_dir):
    return tidy(member_scores(spark, sf_dir).drop("sx", "sy"))


@query(f"WITH {MEMBERS} SELECT bin, count(m.obj_id) AS n_objects FROM bins LEFT JOIN members m USING (bin) GROUP BY bin")
def bin_counts(spark, sf_dir):
    return bins.bin_counts(members(spark, sf_dir), bins.bin_table(spark, GEOMETRY))


@query(f"""WITH {MEMBERS} SELECT bin, count(*) AS n_objects, count(*) FILTER (WHERE score < {LOW}) AS n_outliers,
{rd(f"avg(CASE WHEN score < {LOW} THEN 1.0 ELSE 0.0 END)")} AS fraction FROM members GROUP BY bin""")
def outlier_fraction(spark, sf_dir):
    return tidy(bins.outlier_fraction(member_scores(spark, sf_dir), LOW))


_DRAW = unit("42", "bin", "obj_id")


@query(f"""WITH {MEMBERS}, d AS (SELECT bin, obj_id, row_number() OVER (PARTITION BY bin ORDER BY {_DRAW}, obj_id) AS rn, count(*) OVER (PARTITION BY bin) AS n FROM members)
SELECT bin, obj_id, rn <= floor(n * 0.3::DOUBLE) AS in_train FROM d""")
def train_split(spark, sf_dir):
    return bins.split_train(members(spark, sf_dir).select("bin", "obj_id"), 0.3, 42)


@query(f"""WITH {MEMBERS}, d AS (SELECT bin, obj_id, row_number() OVER (PARTITION BY bin ORDER BY {_DRAW}, obj_id) AS rn FROM members)
SELECT bin, obj_id FROM d WHERE rn <= 10""")
def sample_per_bin(spark, sf_dir):
    return bins.sample_per_group(members(spark, sf_dir).select("bin", "obj_id"), 10, 42)


def _top(order: str) -> str:
    return f"""WITH {MEMBERS}, d AS (SELECT bin, obj_id, score, row_number() OVER (PARTITION BY bin ORDER BY score {order}, obj_id) AS rank FROM members)
SELECT bin, obj_id, {rd("score")} AS score, rank::INTEGER AS rank FROM d WHERE rank <= 5"""


@query(_top("DESC"))
def top_n_per_bin(spark, sf_dir):
    s = member_scores(spark, sf_dir).select("bin", "obj_id", "score")
    return tidy(bins.extremes_per_group(s, 5))


@query(_top("ASC"))
def lowest_n_per_bin(spark, sf_dir):
    s = member_scores(spark, sf_dir).select("bin", "obj_id", "score")
    return tidy(bins.extremes_per_group(s, 5, highest=False))


@query(f"""WITH {MEMBERS}, d AS (SELECT bin, obj_id, row_number() OVER (PARTITION BY bin ORDER BY obj_id) - 1 AS row_no, count(*) OVER (PARTITION BY bin) AS n FROM members)
SELECT bin, obj_id, row_no FROM d WHERE row_no % greatest(n // 20, 1) = 0""")
def systematic_sample(spark, sf_dir):
    return bins.systematic_sample(members(spark, sf_dir), 20).select("bin", "obj_id", "row_no")


@query(f"""WITH {MEMBERS}, c AS (SELECT bin, least(floor(score / 0.05::DOUBLE), 19)::INTEGER AS cell, count(*) AS n FROM members GROUP BY 1, 2),
f AS (SELECT bin, sum(n) AS total, unnest(range(20))::INTEGER AS cell FROM c GROUP BY bin)
SELECT bin, f.cell, {rd("f.cell * 0.05::DOUBLE")} AS edge, coalesce(c.n, 0) AS n, {rd("coalesce(c.n, 0) / (total * 0.05::DOUBLE)")} AS density
FROM f LEFT JOIN c USING (bin, cell)""")
def score_histogram(spark, sf_dir):
    return tidy(diagnose.histogram(member_scores(spark, sf_dir), "score", 0.0, 1.0, 20, ("bin",)))


# --- verdicts across bins ----------------------------------------------------------------------------

_FLAGGED = MEMBERS + f", flagged AS (SELECT bin, obj_id, score FROM members WHERE score < {LOW})"
_COUNTS = _FLAGGED + """, counts AS (SELECT obj_id, count(*) AS n_member, count(f.bin) AS n_flagged
  FROM members m LEFT JOIN flagged f USING (bin, obj_id) GROUP BY obj_id)"""


def _scores(spark, sf_dir):
    return checkpointed(member_scores(spark, sf_dir).select("bin", "obj_id", "x", "y", "score"))


@query(f"""WITH {_COUNTS} SELECT count(*) AS n_outlier_objects, count(*) FILTER (WHERE n_member > 1) AS n_multi,
count(*) FILTER (WHERE n_member > 1 AND n_flagged = n_member) AS n_all, count(*) FILTER (WHERE n_member > 1 AND n_flagged < n_member) AS n_some
FROM counts WHERE n_flagged > 0""")
def cross_bin_consistency(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return crossbin.consistency(s, flagged(s))


@query(f"""WITH {_COUNTS} SELECT bin, obj_id, {rd("score")} AS score FROM flagged
WHERE obj_id NOT IN (SELECT obj_id FROM counts WHERE n_flagged > 0 AND n_member > 1 AND n_flagged < n_member)""")
def inconsistent_antijoin(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return tidy(crossbin.drop_inconsistent(flagged(s), s, flagged(s)).select("bin", "obj_id", "score"))


@query(f"WITH {_COUNTS} SELECT obj_id, n_member, n_flagged, n_flagged >= n_member AS flagged_everywhere FROM counts")
def flagged_superset(spark, sf_dir):
    s = _scores(spark, sf_dir)
    c = crossbin.bins_flagged(s, flagged(s))
    return c.select("obj_id", "n_member", "n_flagged", (F.col("n_flagged") >= F.col("n_member")).alias("flagged_everywhere"))


_DUAL = _FLAGGED + f""", dual AS (
  SELECT obj_id, min(bin) AS bin_a, arg_min(score, bin) AS score_a, max(bin) AS bin_b, arg_max(score, bin) AS score_b
  FROM members GROUP BY obj_id HAVING count(*) = 2),
pairs2 AS (SELECT *, abs(score_a - score_b) AS delta, score_a < {LOW} AS outlier_a, score_b < {LOW} AS outlier_b FROM dual)"""


@query(f"""WITH {_DUAL} SELECT obj_id, bin_a, {rd("score_a")} AS score_a, bin_b, {rd("score_b")} AS score_b, {rd("delta")} AS delta, outlier_a, outlier_b FROM pairs2""")
def dual_bin_scores(spark, sf_dir):
    return tidy(crossbin.dual_scores(_scores(spark, sf_dir), LOW))


@query(f"""WITH {_DUAL},
c AS (SELECT *, CASE WHEN outlier_a AND outlier_b THEN 'both' WHEN outlier_a OR outlier_b THEN 'one' ELSE 'neither' END AS cls FROM pairs2),
rows AS (SELECT *, CASE WHEN cls = 'one' THEN CASE WHEN outlier_a THEN score_b ELSE score_a END END AS other FROM c
         UNION ALL SELECT * REPLACE ('all' AS cls), NULL AS other FROM c)
SELECT cls, count(*) AS n, {rd("avg(delta)")} AS mean_delta, {rd("max(delta)")} AS max_delta, {rd("avg(least(score_a, score_b))")} AS mean_min_score,
{rd("avg(greatest(score_a, score_b))")} AS mean_max_score, {rd("avg(other)")} AS other_mean,
{rd(f"avg(CASE WHEN other IS NOT NULL THEN (abs(other - {LOW}) < 0.1)::INTEGER::DOUBLE END)")} AS other_within_01,
{rd(f"avg(CASE WHEN other IS NOT NULL THEN (abs(other - {LOW}) < 0.2)::INTEGER::DOUBLE END)")} AS other_within_02,
{rd("median(delta)")} AS median_delta, {rd("quantile_cont(delta, 0.9)")} AS p90_delta, {rd("median(other)")} AS other_median
FROM rows GROUP BY cls""")
def dual_bin_summary(spark, sf_dir):
    return tidy(crossbin.dual_summary(checkpointed(crossbin.dual_scores(_scores(spark, sf_dir), LOW)), LOW))


_ANNOTATED = """SELECT f.bin, f.obj_id, {score} AS score, bin_a IS NOT NULL AS dual_bin, coalesce(outlier_a AND outlier_b, false) AS outlier_in_both,
CASE WHEN outlier_a AND outlier_b THEN CASE WHEN f.bin = bin_a THEN bin_b ELSE bin_a END END AS other_bin
FROM flagged f LEFT JOIN pairs2 USING (obj_id)"""


@query(f"WITH {_DUAL} {_ANNOTATED.format(score=rd('score'))}")
def dual_bin_status(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return tidy(crossbin.annotate_dual(flagged(s), crossbin.dual_scores(s, LOW)).select("bin", "obj_id", "score", "dual_bin", "outlier_in_both", "other_bin"))


@query(f"""WITH {_DUAL} SELECT bin, f.obj_id, {rd("score")} AS score, CASE WHEN outlier_a AND outlier_b THEN 'both' ELSE 'one' END AS status
FROM flagged f JOIN pairs2 USING (obj_id) WHERE outlier_a OR outlier_b""")
def dual_bin_points(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return tidy(crossbin.with_status(flagged(s), crossbin.dual_scores(s, LOW)).select("bin", "obj_id", "score", "status"))


@query(f"""WITH {_FLAGGED} SELECT f.bin, f.obj_id, c.c_name, c.c_acctbal, {rd("s.score")} AS score
FROM flagged f LEFT JOIN customer c ON c_custkey = f.obj_id LEFT JOIN members s ON s.bin = f.bin AND s.obj_id = f.obj_id""")
def outlier_lookup(spark, sf_dir):
    s = _scores(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("obj_id"), "c_name", "c_acctbal")
    return crossbin.lookup(flagged(s), c, s).select("bin", "obj_id", "c_name", "c_acctbal", (F.round("score", 6) + 0.0).alias("score"))


@query(f"""WITH {_FLAGGED}, d AS (SELECT bin, obj_id, row_number() OVER (PARTITION BY bin ORDER BY {_DRAW}, obj_id) AS rn, count(*) OVER (PARTITION BY bin) AS n FROM members)
SELECT bin, obj_id, {rd("score")} AS score, rn <= floor(n * 0.5::DOUBLE) AS in_train FROM flagged JOIN d USING (bin, obj_id)""")
def in_train_flag(spark, sf_dir):
    s = _scores(spark, sf_dir)
    split = bins.split_train(s.select("bin", "obj_id"), 0.5, 42)
    return tidy(crossbin.mark_train(flagged(s), split).select("bin", "obj_id", "score", "in_train"))


@query(f"WITH {_FLAGGED} SELECT bin, obj_id, {rd('score')} AS score, row_number() OVER (ORDER BY score, bin, obj_id) AS place FROM flagged")
def outliers_sorted(spark, sf_dir):
    from plumbline.operators.ranks import numbered

    s = _scores(spark, sf_dir)
    # one part a bin, put together as the results of separate bins are
    parts = [flagged(s).filter(F.col("bin") == b) for b in range(GEOMETRY.n)]
    rows = numbered(crossbin.combine(parts), ["score", "bin", "obj_id"])
    return rows.select("bin", "obj_id", (F.round("score", 6) + 0.0).alias("score"), (F.col("row_no") + 1).alias("place"))


# --- metrics against each other ----------------------------------------------------------------------

_BEST = "best AS (SELECT metric, bin, (1 + count(*) % 5)::INTEGER AS best_k FROM flags GROUP BY 1, 2)"


def _best(outliers):
    return outliers.groupBy("metric", "bin").agg((1 + F.count(F.lit(1)) % 5).cast("int").alias("best_k"))


@query(f"""WITH {METRIC_OUTLIERS}, {_BEST}
SELECT metric, (SELECT count(*) FROM flags f WHERE f.metric = b.metric) AS n_outliers, (SELECT count(DISTINCT obj_id) FROM flags f WHERE f.metric = b.metric) AS n_objects,
string_agg(best_k::VARCHAR, ',' ORDER BY bin) AS best_ks FROM best b GROUP BY metric""")
def metric_summary(spark, sf_dir):
    o = metric_outliers(spark, sf_dir)
    return crossbin.metric_summary(o, _best(o))


@query(f"WITH {METRIC_OUTLIERS} SELECT metric, bin, count(*) AS n_outliers FROM flags GROUP BY 1, 2")
def metric_bin_counts(spark, sf_dir):
    return crossbin.metric_bin_counts(metric_outliers(spark, sf_dir))


@query(f"""WITH {METRIC_OUTLIERS}, ids AS (SELECT DISTINCT metric, obj_id FROM flags), n AS (SELECT metric, count(*) AS n FROM ids GROUP BY 1),
ms AS (SELECT a.metric, b.metric AS other FROM n a, n b),
s AS (SELECT a.metric, b.metric AS other, count(*) AS n_shared FROM ids a JOIN ids b USING (obj_id) GROUP BY 1, 2)
SELECT metric, other, coalesce(n_shared, 0)::BIGINT AS n_shared, {rd("100.0 * coalesce(n_shared, 0) / n")} AS percent FROM ms LEFT JOIN s USING (metric, other) JOIN n USING (metric)""")
def metric_agreement(spark, sf_dir):
    return tidy(crossbin.agreement(metric_outliers(spark, sf_dir), list(METRIC_SCORES)))


@query(f"WITH {METRIC_OUTLIERS} SELECT obj_id FROM flags WHERE metric = 'std_z' INTERSECT SELECT obj_id FROM flags WHERE metric = 'rmse'")
def shared_outliers(spark, sf_dir):
    return crossbin.shared_objects(metric_outliers(spark, sf_dir), "std_z", "rmse")


# --- what a run leaves, and its readers ---------------------------------------------------------------


@query("""SELECT c_custkey AS obj_id, c_acctbal AS parallax, c_nationkey::DOUBLE AS colour, t AS magnitude
FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE c_acctbal > 0""")
def catalogue_csv(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("magnitude"))
    c = table(spark, sf_dir, "customer").join(t, F.col("c_custkey") == F.col("o_custkey"), "left")
    path = scratch_path(spark, "catalogue")
    c.select("c_name", F.col("c_custkey").alias("obj_id"), "magnitude", F.col("c_nationkey").alias("colour"), F.col("c_acctbal").alias("parallax")).write.csv(path, header=True)
    return store.read_catalogue(spark, path)


@query("""SELECT 'line' AS kind, p_size % 3 AS list_no, p_type AS species, p_retailprice AS x, NULL::DOUBLE AS x_end, count(*) AS n FROM part GROUP BY ALL
UNION ALL SELECT 'band', NULL, p_type, p_retailprice, p_retailprice + p_size, count(*) FROM part GROUP BY ALL""")
def line_lists(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    folder = scratch_path(spark, "lists")
    for no, name in enumerate(store.LINE_LISTS):
        part.filter(F.col("p_size") % 3 == no).select(F.col("p_type").alias("species"), F.col("p_retailprice").alias("x")).write.csv(f"{folder}/{name}.csv", header=True)
    part.select(F.col("p_type").alias("species"), F.col("p_retailprice").alias("x_start"), (F.col("p_retailprice") + F.col("p_size")).alias("x_end")).write.csv(f"{folder}/{store.BAND_LIST}.csv", header=True)
    # a table of several partitions is written as several files a list
    lines, bands = store.read_lines(spark, folder, parts=True)
    none = F.lit(None)
    rows = lines.select(F.lit("line").alias("kind"), "list_no", "species", "x", none.cast("double").alias("x_end"))
    rows = rows.unionByName(bands.select(F.lit("band").alias("kind"), none.cast("int").alias("list_no"), "species", F.col("x_start").alias("x"), "x_end"))
    return rows.groupBy("kind", "list_no", "species", "x", "x_end").agg(F.count(F.lit(1)).alias("n"))


def _stored(spark, sf_dir):
    s = _scores(spark, sf_dir)
    results = store.ResultStore(spark, scratch_path(spark, "results"))
    results.write("object_scores", s.select("bin", "obj_id", "score", F.lit("std_z").alias("metric")))
    results.write("outliers", flagged(s).withColumn("metric", F.lit("std_z")))
    summary = bins.outlier_fraction(s, LOW).drop("fraction").withColumns({"metric": F.lit("std_z"), "threshold": F.lit(LOW)})
    results.write("bin_summary", summary)
    return results


@query(f"""WITH {_FLAGGED} SELECT 'scores' AS what, bin, count(*) AS n, {rd("avg(score)")} AS mean FROM members GROUP BY bin
UNION ALL SELECT 'outliers', bin, count(*), {rd("avg(score)")} FROM flagged GROUP BY bin
UNION ALL SELECT 'summary', bin, count(*) FILTER (WHERE score < {LOW}), {rd(f"{LOW}::DOUBLE")} FROM members GROUP BY bin""")
def result_tables(spark, sf_dir):
    results = _stored(spark, sf_dir)

    def stats(what, tbl):
        return results.read(tbl, "std_z").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).select(F.lit(what).alias("what"), "bin", "n", "mean")

    s = results.read("bin_summary", "std_z").select(F.lit("summary").alias("what"), "bin", F.col("n_outliers").alias("n"), F.col("threshold").alias("mean"))
    return tidy(stats("scores", "object_scores").unionByName(stats("outliers", "outliers")).unionByName(s))


@query(f"WITH {_FLAGGED} SELECT b.bin, count(f.obj_id) AS n FROM (SELECT DISTINCT bin FROM members) b LEFT JOIN flagged f USING (bin) GROUP BY b.bin")
def available_bins(spark, sf_dir):
    results = _stored(spark, sf_dir)
    out = results.read("outliers", "std_z").select("bin", "obj_id")
    return results.available_bins("std_z").join(out, "bin", "left").groupBy("bin").agg(F.count("obj_id").alias("n"))


@query(f"""WITH {_DUAL}, o AS ({_ANNOTATED.format(score="score")})
SELECT {rd("x")} AS e1, {rd("y")} AS e2, o.obj_id, o.bin, {rd("o.score")} AS score, dual_bin, outlier_in_both, other_bin
FROM o JOIN members m ON m.bin = o.bin AND m.obj_id = o.obj_id""")
def outlier_table(spark, sf_dir):
    s = _scores(spark, sf_dir)
    embedding = s.select("bin", "obj_id", F.col("x").alias("e1"), F.col("y").alias("e2"))
    return tidy(crossbin.outlier_table(flagged(s), crossbin.dual_scores(s, LOW), embedding))


@query(f"""WITH {MEMBERS}, done AS (SELECT DISTINCT bin FROM members WHERE score < 0.55)
SELECT bin, k, 'bin' || lpad(bin::VARCHAR, 2, '0') || '_k' || k || '_q3' AS model_id FROM (SELECT DISTINCT bin FROM members), (VALUES (1), (2)) t(k)
WHERE k = 2 OR bin NOT IN (SELECT bin FROM done)""")
def untrained_grid(spark, sf_dir):
    s = _scores(spark, sf_dir)
    name = F.format_string("bin%02d_k%d_q3", F.col("bin"), F.col("k"))
    wanted = s.select("bin").distinct().withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("model_id", name)
    models = store.ModelStore(spark, scratch_path(spark, "models"))
    done = s.filter("score < 0.55").select("bin").distinct().withColumn("k", F.lit(1)).withColumn("model_id", name)
    registry = done.select("model_id", F.col("bin").alias("grp"), "k", F.lit(9.0).alias("q2"), F.lit(1).alias("n_iter"), F.lit(True).alias("converged"), F.lit(0.0).alias("loss"))
    registry.write.partitionBy("model_id").parquet(f"{models.path}/models")
    return models.missing(wanted).select("bin", "k", "model_id")


@query()
def residual_embedding(spark, sf_dir):
    """Two-dimensional embedding of the embeddings table's vectors on their own components, a bin a label."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").alias("bin"), F.col("vec_id").alias("obj_id"), F.col("embedding").cast("array<double>").alias("r"))
    return embed(vectors)
