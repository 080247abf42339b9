"""Queries that corrupt the price cells with known labels and measure what is found."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import cells as ops, diagnose, inject, metrics, prepare
from plumbline.functions.scores import CELL_SCORES
from plumbline.functions.losses import Cauchy
from plumbline.runtime import checkpointed
from plumbline.workload.inputs import N_MONTHS, PRICES, Q, Q2, price_objects, query, rd, tidy, unit

GRID = f""",
grid AS (SELECT obj_id, CAST(f AS INTEGER) AS feat_id FROM (SELECT DISTINCT obj_id FROM cells) o, range({N_MONTHS}) t(f)),
full_cells AS (SELECT obj_id, feat_id, coalesce(cells.y, 0) AS y, coalesce(cells.w, 0) AS w FROM grid LEFT JOIN cells USING (obj_id, feat_id))"""
FULL = PRICES + GRID


def _full(spark, sf_dir):
    """Dense cells, missing ones included."""
    return checkpointed(prepare.objects_to_cells(price_objects(spark, sf_dir)))


def _both(cells, labels):
    """Corrupted cells with their label, one row a cell."""
    lab = labels.select("obj_id", "feat_id", F.lit(True).alias("label"))
    rows = cells.join(lab, ["obj_id", "feat_id"], "left").withColumn("label", F.coalesce("label", F.lit(False)))
    return tidy(rows.select("obj_id", "feat_id", "y", "w", "label"))


def _picked(seed: str, n: int) -> str:
    return f"(SELECT obj_id FROM (SELECT DISTINCT obj_id FROM full_cells) ORDER BY {unit(seed, 'obj_id')}, obj_id LIMIT {n})"


def _between(u: str, low: float, high: float) -> str:
    return f"({low} + {u} * {high - low!r})"


_WAVE = f"1 + {_between(unit('0/sin/a', 'obj_id'), 0.05, 0.2)} * sin({_between(unit('0/sin/f', 'obj_id'), 5.0, 20.0)} * 2 * pi() * feat_id / {N_MONTHS - 1}.0)"


@query(f"""WITH {FULL}, p AS {_picked("0/sin", 4)}
SELECT obj_id, feat_id, {rd(f"CASE WHEN obj_id IN (FROM p) THEN {_WAVE} ELSE y END")} AS y, {rd("w")} AS w, obj_id IN (FROM p) AS label FROM full_cells""")
def inject_sinusoids(spark, sf_dir):
    return _both(*inject.sinusoids(_full(spark, sf_dir), N_MONTHS, n=4))


_KEYS = ("obj_id", "feat_id")


def _jump(kind: str) -> str:
    a, s = unit(f"0/{kind}/a", *_KEYS), unit(f"0/{kind}/s", *_KEYS)
    return f"{_between(a, 0.5, 1.0)} * CASE WHEN {s} < 0.5 THEN -1.0 ELSE 1.0 END"


_SPIKED = f"""spiked AS (SELECT obj_id, feat_id, {unit("0/cell", *_KEYS)} < 0.02 AS label,
  CASE WHEN {unit("0/cell", *_KEYS)} < 0.02 THEN y + {_jump("cell")} ELSE y END AS y, w FROM full_cells)"""


@query(f"WITH {FULL}, {_SPIKED} SELECT obj_id, feat_id, {rd('y')} AS y, {rd('w')} AS w, label FROM spiked")
def inject_spikes(spark, sf_dir):
    return _both(*inject.spikes(_full(spark, sf_dir), 0.02))


@query(f"""WITH {FULL}, c AS (SELECT feat_id FROM (SELECT f::INTEGER AS feat_id FROM range({N_MONTHS}) t(f)) ORDER BY {unit("0/col", "feat_id")}, feat_id LIMIT 3),
m AS (SELECT *, feat_id IN (FROM c) AND {unit("0/col/o", *_KEYS)} < 0.3 AS label FROM full_cells)
SELECT obj_id, feat_id, {rd(f"CASE WHEN label THEN y + {_jump('col')} ELSE y END")} AS y, {rd("w")} AS w, label FROM m""")
def inject_bad_columns(spark, sf_dir):
    return _both(*inject.bad_columns(_full(spark, sf_dir), N_MONTHS, n=3))


def _dips_sql() -> str:
    parts, hits = [], []
    for i in range(3):
        c = f"floor({unit('0/dip/c', 'obj_id', str(i))} * {N_MONTHS})"
        prof = f"exp(-0.5 * ((feat_id - {c}) / 1.5) ** 2)"
        parts.append(f"{_between(unit('0/dip/a', 'obj_id', str(i)), 0.1, 0.3)} * {prof}")
        hits.append(f"{prof} > 0.01")
    return f"""dipped AS (SELECT obj_id, feat_id, w, obj_id IN (FROM p) AND ({" OR ".join(hits)}) AS label,
  CASE WHEN obj_id IN (FROM p) THEN y - ({" + ".join(parts)}) ELSE y END AS y FROM full_cells)"""


@query(f"WITH {FULL}, p AS {_picked('0/dip', 6)}, {_dips_sql()} SELECT obj_id, feat_id, {rd('y')} AS y, {rd('w')} AS w, label FROM dipped")
def inject_dips(spark, sf_dir):
    return _both(*inject.dips(_full(spark, sf_dir), N_MONTHS, n=6, width=1.5))


def _gaps_sql(segments: int, low: int, high: int) -> str:
    """Missing stretches in half of the objects, clear of the spikes and of the stretches before."""
    out = f"""open0 AS MATERIALIZED (SELECT obj_id, feat_id FROM spiked WHERE NOT label AND {unit("0/gap", "obj_id")} < 0.5)"""
    for i in range(segments):
        out += f""",
free{i} AS MATERIALIZED (SELECT obj_id, feat_id, feat_id - row_number() OVER (PARTITION BY obj_id ORDER BY feat_id) AS i FROM open{i}),
regions{i} AS MATERIALIZED (SELECT obj_id, min(feat_id) AS s, count(*) AS len FROM free{i} GROUP BY obj_id, i HAVING count(*) >= {low}),
ranked{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY s) - 1 AS no, count(*) OVER (PARTITION BY obj_id) AS m FROM regions{i}),
one{i} AS MATERIALIZED (SELECT *, {low} + floor({unit(f"0/gap/l{i}", "obj_id")} * (least({high}, len) - {low} + 1)) AS l FROM ranked{i}
           WHERE no = floor({unit(f"0/gap/r{i}", "obj_id")} * m)),
gap{i} AS MATERIALIZED (SELECT obj_id, s + floor({unit(f"0/gap/s{i}", "obj_id")} * (len - l + 1)) AS b, l FROM one{i}),
open{i + 1} AS MATERIALIZED (SELECT obj_id, feat_id FROM open{i} LEFT JOIN gap{i} USING (obj_id) WHERE b IS NULL OR feat_id < b OR feat_id > b + l - 1)"""
    gone = " UNION ALL ".join(f"SELECT obj_id, feat_id FROM open{i} ANTI JOIN open{i + 1} USING (obj_id, feat_id)" for i in range(segments))
    return f"""WITH {FULL}, {_SPIKED}, {out}, gone AS MATERIALIZED ({gone})
SELECT s.obj_id, s.feat_id, {rd("CASE WHEN g.obj_id IS NULL THEN y ELSE 0 END")} AS y, {rd("CASE WHEN g.obj_id IS NULL THEN w ELSE 0 END")} AS w, g.obj_id IS NOT NULL AS label
FROM spiked s LEFT JOIN gone g USING (obj_id, feat_id)"""


@query(_gaps_sql(1, 5, 12))
def inject_missing_segments(spark, sf_dir):
    cells, labels = inject.spikes(_full(spark, sf_dir), 0.02)
    return _both(*inject.missing_segments(cells, labels, fraction=0.5, min_length=5, max_length=12))


@query(_gaps_sql(2, 3, 8))
def inject_two_missing_segments(spark, sf_dir):
    """Two stretches an object, which do not overlap."""
    cells, labels = inject.spikes(_full(spark, sf_dir), 0.02)
    return _both(*inject.missing_segments(cells, labels, fraction=0.5, segments=2, min_length=3, max_length=8))


# --- what is found ---------------------------------------------------------------------------------

# Spikes ten times as high, so that they stand out of the noise.
_TALL = f"""spiked AS (SELECT obj_id, feat_id, {unit("0/cell", *_KEYS)} < 0.02 AS label, w,
  CASE WHEN {unit("0/cell", *_KEYS)} < 0.02 THEN y + {_between(unit("0/cell/a", *_KEYS), 5.0, 10.0)} * CASE WHEN {unit("0/cell/s", *_KEYS)} < 0.5 THEN -1.0 ELSE 1.0 END ELSE y END AS y FROM full_cells)"""
_WAVES = f"""p AS {_picked("0/sin", 4)}, waved AS (SELECT obj_id, feat_id, w, obj_id IN (FROM p) AS odd, label,
  CASE WHEN obj_id IN (FROM p) THEN {_WAVE} ELSE y END AS y FROM spiked)"""
_SCORED = f"""basis AS (SELECT feat_id, sum(w * y) / sum(w) AS g FROM waved WHERE w > 0 GROUP BY 1),
coeffs AS (SELECT obj_id, sum(w * y * g) / sum(w * g * g) AS a FROM waved JOIN basis USING (feat_id) GROUP BY 1),
weighted AS (SELECT obj_id, feat_id, y, w, label, odd, coalesce({Q2} / ({Q2} + w * (y - a*g) * (y - a*g)), 1) AS w_rob
             FROM waved LEFT JOIN basis USING (feat_id) JOIN coeffs USING (obj_id))"""
_ALL = f"WITH {FULL}, {_TALL}, {_WAVES}, {_SCORED}"


def _corrupted(spark, sf_dir):
    """Cells with tall spikes and some sinusoid objects, their labels, and the weights of a rank-one model."""
    full = _full(spark, sf_dir)
    spiked, spikes = inject.spikes(full, 0.02, (5.0, 10.0))
    cells, waves = inject.sinusoids(spiked, N_MONTHS, n=4)
    cells = checkpointed(cells)
    basis = ops.mean_basis(cells)
    coeffs = ops.a_step(cells, basis, 1)
    weighted = ops.with_weights(ops.with_prediction(cells, coeffs, basis, 1), Cauchy(Q))
    return checkpointed(weighted), checkpointed(spikes), checkpointed(waves)


def _f1(t: str, p: str, source: str) -> str:
    tp, fp, fn = (f"count(*) FILTER (WHERE {c})" for c in (f"{t} AND {p}", f"NOT {t} AND {p}", f"{t} AND NOT {p}"))
    return f"""SELECT {tp} AS tp, {fp} AS fp, {fn} AS fn, {rd(f"coalesce({tp} / nullif({tp} + {fp}, 0)::DOUBLE, 0)")} AS "precision",
{rd(f"coalesce({tp} / nullif({tp} + {fn}, 0)::DOUBLE, 0)")} AS recall, {rd(f"coalesce(2.0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0)::DOUBLE, 0)")} AS f1 FROM {source}"""


@query(f"{_ALL} {_f1('(label OR odd)', '(w_rob < 0.5)', 'weighted')}")
def f1_cell(spark, sf_dir):
    weighted, spikes, waves = _corrupted(spark, sf_dir)
    truth = diagnose.label_union([spikes, waves]).withColumn("t", F.lit(True))
    rows = weighted.join(truth, ["obj_id", "feat_id"], "left").withColumns({"t": F.coalesce("t", F.lit(False)), "p": F.col("w_rob") < 0.5})
    return tidy(metrics.detection_f1(rows, "t", "p"))


@query(f"{_ALL}, o AS (SELECT obj_id, bool_or(odd) AS t, median(w_rob) < 0.9 AS p FROM weighted GROUP BY 1) {_f1('t', 'p', 'o')}")
def f1_object(spark, sf_dir):
    weighted, _, waves = _corrupted(spark, sf_dir)
    scores = ops.object_scores(weighted, {"median": CELL_SCORES["median"]})
    truth = diagnose.object_labels(waves, ["object"]).withColumn("t", F.lit(True))
    rows = scores.join(truth, "obj_id", "left").withColumns({"t": F.coalesce("t", F.lit(False)), "p": F.col("median") < 0.9})
    return tidy(metrics.detection_f1(rows, "t", "p"))


@query(f"{_ALL} SELECT obj_id, feat_id FROM weighted WHERE label OR odd")
def label_union(spark, sf_dir):
    _, spikes, waves = _corrupted(spark, sf_dir)
    return diagnose.label_union([spikes, waves])


@query(f"{_ALL} SELECT obj_id, bool_or(label OR odd) AS any_cell, bool_or(odd) AS odd FROM weighted GROUP BY 1")
def object_labels(spark, sf_dir):
    weighted, spikes, waves = _corrupted(spark, sf_dir)
    marks = diagnose.label_union([spikes, waves]).withColumn("label", F.lit(True))
    cells = weighted.select("obj_id", "feat_id").join(marks, ["obj_id", "feat_id"], "left").withColumn("label", F.coalesce("label", F.lit(False)))
    odd = diagnose.object_labels(waves).withColumn("odd", F.lit(True))
    return diagnose.any_label(cells).withColumnRenamed("label", "any_cell").join(odd, "obj_id", "left").withColumn("odd", F.coalesce("odd", F.lit(False)))


@query(f"""{_ALL}, k AS (SELECT *, 'clean' AS kind FROM weighted WHERE NOT label AND NOT odd UNION ALL SELECT *, 'cell' FROM weighted WHERE label UNION ALL SELECT *, 'object' FROM weighted WHERE odd)
SELECT kind, count(*) AS n, {rd("avg(w_rob)")} AS mean, {rd("stddev_pop(w_rob)")} AS std, {rd("min(w_rob)")} AS lo, {rd("max(w_rob)")} AS hi FROM k GROUP BY kind""")
def weights_by_class(spark, sf_dir):
    weighted, spikes, waves = _corrupted(spark, sf_dir)
    return tidy(diagnose.by_class(diagnose.with_kinds(weighted, spikes.unionByName(waves)), "w_rob", "kind"))
