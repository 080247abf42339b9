"""Calibration metrics of held-out cells, and the choice of the best model by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.measure import METRIC_TARGETS, metric_deviation
from plumbline.operators.ranks import quantiles

METRICS = ("std_z", "chi2_red", "rmse", "mad_z", "kl")


def calibration(cells: DataFrame, by: tuple[str, ...] = (), missing: str = "count", approximate: bool = False) -> DataFrame:
    """One row a group with every metric, from cells carrying ``w``, ``r`` and ``z``.

    All but the median are sums in a single partially aggregated pass. The median of |z| over all
    cells of a group is exact, by narrowing when the group is large; ``approximate`` swaps in a sketch.
    """
    if missing not in ("count", "skip"):
        raise ValueError(f"missing must be 'count' or 'skip', got {missing!r}")
    kept = cells if missing == "count" else cells.filter(F.col("w") > 0)
    w, r, z = F.col("w"), F.col("r"), F.col("z")
    std, chi2, mu = F.stddev_pop(z), F.avg(w * r * r), F.avg(z)
    aggs = [
        std.alias("std_z"),
        chi2.alias("chi2_red"),
        F.sqrt(chi2).alias("rmse"),
        F.when(std > 0, -F.log(std) + (std * std + mu * mu) / 2 - F.lit(0.5)).alias("kl"),
    ]
    if approximate:
        return kept.groupBy(*by).agg(*aggs, F.percentile_approx(F.abs(z), F.lit(0.5), F.lit(10000)).alias("mad_z"))
    sums = kept.groupBy(*by).agg(*aggs)
    med = quantiles(kept.withColumn("az", F.abs(z)), "az", {"mad_z": 0.5}, by)
    if not by:
        return sums.withColumn("mad_z", med.scalar())
    return sums.join(med, list(by))


def long_scores(wide: DataFrame, keys: tuple[str, ...], metrics: tuple[str, ...] = tuple(METRIC_TARGETS)) -> DataFrame:
    """(keys..., metric, value)."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def best_models(scores: DataFrame, by: tuple[str, ...] = ("bin",)) -> DataFrame:
    """The (k, q) nearest the target, for each group and metric; ties go to the smaller k, then q.

    ``scores`` is (by..., k, q, metric, value). A group holds one row a grid point.
    """
    ranked = scores.withColumn("deviation", metric_deviation(F.col("metric"), F.col("value")))
    order = Window.partitionBy(*by, "metric").orderBy("deviation", "k", "q")
    best = ranked.filter(F.col("deviation").isNotNull() & ~F.isnan("deviation")).withColumn("rn", F.row_number().over(order))
    return best.filter("rn = 1").select(*by, "metric", F.col("k").alias("best_k"), F.col("q").alias("best_q"), "value", "deviation")


def detection_f1(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, precision, recall and F1 of a boolean prediction against a boolean truth."""
    t, p = F.col(truth), F.col(predicted)
    counts = df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    zero = F.lit(0.0)
    return counts.withColumns({
        "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
        "f1": F.coalesce(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), zero),
    })
