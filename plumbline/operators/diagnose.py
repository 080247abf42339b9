"""Diagnostics of residuals, weights and labels."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.ranks import quantiles


def residual_summary(cells: DataFrame, max_group: int | None = None) -> DataFrame:
    """Median, 16th and 84th percentile and RMS of the residual of every feature.

    A feature has one cell an object, so its quantiles go through the narrowing that never brings
    a large group to one task.
    """
    rms = cells.groupBy("feat_id").agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"), F.count(F.lit(1)).alias("n"))
    q = quantiles(cells, "r", {"median": 0.5, "p16": 0.16, "p84": 0.84}, ("feat_id",), max_group)
    return rms.join(q, "feat_id")


def histogram(df: DataFrame, value: str, low: float, high: float, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and density on ``n`` equal bins, the last one closed; values outside are not counted."""
    v = F.col(value)
    step = (high - low) / n
    cell = F.least(F.floor((v - F.lit(float(low))) / F.lit(step)), F.lit(n - 1)).cast("int")
    counts = df.filter(v.between(low, high)).groupBy(*by, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    # counts is already small: groups x n rows at most
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    frame = totals.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    full = frame.join(counts, [*by, "cell"], "left")
    number = F.coalesce("n", F.lit(0).cast("bigint"))
    return full.select(
        *by,
        "cell",
        (F.lit(float(low)) + F.col("cell") * F.lit(step)).alias("edge"),
        number.alias("n"),
        (number / (F.col("total") * F.lit(step))).alias("density"),
    )


def object_labels(labels: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Objects with at least one labelled cell (of the given kinds)."""
    kept = labels if kinds is None else labels.filter(F.col("kind").isin(kinds))
    return kept.select("obj_id").distinct()


def any_label(cells: DataFrame, label: str = "label") -> DataFrame:
    """(obj_id, label): whether any cell of the object carries the label."""
    return cells.groupBy("obj_id").agg(F.bool_or(F.col(label)).alias(label))


def label_union(parts: list[DataFrame]) -> DataFrame:
    """Union of label tables: the distinct labelled cells, whatever the kind."""
    out = parts[0].select("obj_id", "feat_id")
    for p in parts[1:]:
        out = out.union(p.select("obj_id", "feat_id"))
    return out.distinct()


def with_kinds(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells once for every kind of label they carry; unlabelled ones as ``clean``."""
    return cells.join(labels, ["obj_id", "feat_id"], "left").withColumn("kind", F.coalesce("kind", F.lit("clean")))


def by_class(df: DataFrame, value: str, cls: str) -> DataFrame:
    """Count, mean, spread, least and greatest of a value for every class."""
    v = F.col(value)
    return df.groupBy(cls).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )


def noise_level(cells: DataFrame) -> DataFrame:
    """Spread of each object's present cells."""
    return cells.filter(F.col("w") > 0).groupBy("obj_id").agg(F.stddev_pop("y").alias("noise"))


def low_noise(cells: DataFrame, p: float = 0.9) -> DataFrame:
    """Objects with their noise, the cut at the p-th quantile over all objects, and whether they are below it."""
    levels = noise_level(cells)
    cut = quantiles(levels, "noise", {"cut": p}).scalar()
    return levels.withColumn("cut", cut).withColumn("low_noise", F.col("noise") < F.col("cut"))


def weight_quantiles(cells: DataFrame, q: float, probs: list[float], weight: str = "w_rob") -> DataFrame:
    """Empirical quantiles of the weights beside ``Q² / (Q² + Φ⁻¹(p)²)``, which unit normal residuals give."""
    names = {f"p{i}": p for i, p in enumerate(probs)}
    wide = quantiles(cells, weight, names)
    rows = F.array(*[
        F.struct(
            F.lit(float(p)).alias("p"),
            F.lit(q * q / (q * q + NormalDist().inv_cdf(p) ** 2)).alias("expected"),
            F.col(n).alias("observed"),
        )
        for n, p in names.items()
    ])
    return wide.select(F.inline(rows))

