"""Labelled corruptions of a user's own cells, for injection and recovery.

Everything is drawn by hash from a seed and the keys, so a table gets the same corruption on any
cluster. Each operator returns (cells, labels) with labels (obj_id, feat_id, kind). Cells are
(obj_id, feat_id, y, w) and must include the missing ones where these may be changed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.draws import between, sign, uniform
from plumbline.runtime import checkpointed, pin_small


# Draws of objects are counted in so many equal slices of [0, 1); the driver sees one count a slice.
SLICES = 1 << 16


def pick_objects(cells: DataFrame, n: int, seed: int | str, slices: int = SLICES) -> DataFrame:
    """The ``n`` objects with the smallest draws.

    Counts of slices of the draws tell where the number is reached. Objects before that slice are taken as they lie,
    and only the objects of that slice, about one in ``slices``, are ordered.
    """
    drawn = cells.select("obj_id").distinct().withColumn("_u", uniform(seed, F.col("obj_id")))
    drawn = checkpointed(drawn.withColumn("_s", F.floor(F.col("_u") * slices).cast("int")))
    counts = drawn.groupBy("_s").count().toArrow()
    at, size = counts["_s"].to_numpy(), counts["count"].to_numpy()
    order = at.argsort()
    before = size[order].cumsum() - size[order]
    within = (before + size[order]) > n
    if not within.any():
        return drawn.select("obj_id")
    edge, taken = int(at[order][within][0]), int(before[within][0])
    last = drawn.filter(F.col("_s") == edge).orderBy("_u", "obj_id").limit(n - taken)
    return drawn.filter(F.col("_s") < edge).unionByName(last).select("obj_id")


def pick_features(n_features: int, n: int, seed: int | str, spark) -> DataFrame:
    feats = spark.range(n_features).select(F.col("id").cast("int").alias("feat_id"))
    return feats.withColumn("_u", uniform(seed, F.col("feat_id"))).orderBy("_u", "feat_id").limit(n).select("feat_id")


def _labels(cells: DataFrame, cond: Column, kind: str) -> DataFrame:
    return cells.filter(cond).select("obj_id", "feat_id", F.lit(kind).alias("kind"))


def sinusoids(cells: DataFrame, n_features: int, n: int = 5, freq=(5.0, 20.0), amp=(0.05, 0.2), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Replace ``n`` whole objects by 1 + a sinusoid of random frequency and amplitude."""
    picked = pick_objects(cells, n, f"{seed}/sin").select(
        "obj_id",
        between(uniform(f"{seed}/sin/f", F.col("obj_id")), *freq).alias("_f"),
        between(uniform(f"{seed}/sin/a", F.col("obj_id")), *amp).alias("_a"),
    )
    joined = cells.join(pin_small(picked), "obj_id", "left")
    wave = F.lit(1.0) + F.col("_a") * F.sin(F.col("_f") * F.lit(2.0 * math.pi) * F.col("feat_id") / F.lit(float(n_features - 1)))
    hit = F.col("_f").isNotNull()
    out = joined.withColumn("y", F.when(hit, wave).otherwise(F.col("y")))
    return out.select(*cells.columns), _labels(joined, hit, "object")


def spikes(cells: DataFrame, rate: float, amp=(0.5, 1.0), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Add a positive or negative spike to a fraction of single cells. Narrow."""
    keys = (F.col("obj_id"), F.col("feat_id"))
    hit = uniform(f"{seed}/cell", *keys) < rate
    jump = between(uniform(f"{seed}/cell/a", *keys), *amp) * sign(uniform(f"{seed}/cell/s", *keys))
    out = cells.withColumn("y", F.when(hit, F.col("y") + jump).otherwise(F.col("y")))
    return out, _labels(cells, hit, "cell")


def bad_columns(cells: DataFrame, n_features: int, n: int = 5, fraction: float = 0.3, amp=(0.5, 1.0), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Spikes at ``n`` features, each in a fraction of the objects."""
    keys = (F.col("obj_id"), F.col("feat_id"))
    cols = pick_features(n_features, n, f"{seed}/col", cells.sparkSession).withColumn("_c", F.lit(True))
    joined = cells.join(pin_small(cols), "feat_id", "left")
    hit = F.col("_c").isNotNull() & (uniform(f"{seed}/col/o", *keys) < fraction)
    jump = between(uniform(f"{seed}/col/a", *keys), *amp) * sign(uniform(f"{seed}/col/s", *keys))
    out = joined.withColumn("y", F.when(hit, F.col("y") + jump).otherwise(F.col("y")))
    return out.select(*cells.columns), _labels(joined, hit, "column")


def dips(cells: DataFrame, n_features: int, n: int = 5, lines: int = 3, amp=(0.1, 0.3), width: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Subtract ``lines`` Gaussian dips at random places from ``n`` objects; cells above 1% of a dip's depth are labelled."""
    picked = pick_objects(cells, n, f"{seed}/dip")
    shape = []
    for i in range(lines):
        at = F.floor(uniform(f"{seed}/dip/c", F.col("obj_id"), F.lit(i)) * n_features)
        shape.append(F.struct(at.alias("c"), between(uniform(f"{seed}/dip/a", F.col("obj_id"), F.lit(i)), *amp).alias("a")))
    joined = cells.join(pin_small(picked.select("obj_id", F.array(*shape).alias("_d"))), "obj_id", "left")
    feat = F.col("feat_id")

    def profile(d: Column) -> Column:
        off = (feat - d["c"]) / F.lit(float(width))
        return F.exp(F.lit(-0.5) * off * off)

    depth = F.aggregate("_d", F.lit(0.0), lambda s, d: s + d["a"] * profile(d))
    hit = F.coalesce(F.exists("_d", lambda d: profile(d) > 0.01), F.lit(False))
    out = joined.withColumn("y", F.col("y") - F.coalesce(depth, F.lit(0.0)))
    return out.select(*cells.columns), _labels(joined, hit, "dip")


def free_regions(cells: DataFrame, avoid: DataFrame, min_length: int) -> DataFrame:
    """Runs of cells without any of the labels to avoid: (obj_id, s, e, len, no), ``e`` past the end.

    A window holds one object's cells, at most one a feature.
    """
    order = Window.partitionBy("obj_id").orderBy("feat_id")
    free = cells.select("obj_id", "feat_id").join(avoid.select("obj_id", "feat_id").distinct(), ["obj_id", "feat_id"], "left_anti")
    runs = free.withColumn("_i", F.col("feat_id") - F.row_number().over(order)).groupBy("obj_id", "_i").agg(
        F.min("feat_id").alias("s"), (F.max("feat_id") + 1).alias("e")
    )
    long = runs.withColumn("len", F.col("e") - F.col("s")).filter(F.col("len") >= min_length)
    return long.withColumn("no", F.row_number().over(Window.partitionBy("obj_id").orderBy("s")) - 1).drop("_i")


def missing_segments(
    cells: DataFrame,
    avoid: DataFrame,
    fraction: float = 0.1,
    segments: int = 1,
    min_length: int = 5,
    max_length: int = 50,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Make ``segments`` stretches of a fraction of the objects missing, clear of the labels in ``avoid``.

    The region, the length and the start are drawn by hash. A later segment keeps clear of the
    earlier ones of its object as well.
    """
    chosen = checkpointed(cells.filter(uniform(f"{seed}/gap", F.col("obj_id")) < fraction).select("obj_id", "feat_id"))
    taken = checkpointed(avoid.select("obj_id", "feat_id"))
    gaps = None
    for i in range(segments):
        regions = free_regions(chosen, taken if gaps is None else taken.union(gaps), min_length)
        many = F.count(F.lit(1)).over(Window.partitionBy("obj_id"))
        one = regions.withColumn("_m", many).filter(F.col("no") == F.floor(uniform(f"{seed}/gap/r{i}", F.col("obj_id")) * F.col("_m")))
        longest = F.least(F.lit(max_length), F.col("len"))
        length = F.lit(min_length) + F.floor(uniform(f"{seed}/gap/l{i}", F.col("obj_id")) * (longest - min_length + 1))
        begin = F.col("s") + F.floor(uniform(f"{seed}/gap/s{i}", F.col("obj_id")) * (F.col("len") - F.col("_l") + 1))
        cut = one.withColumn("_l", length).withColumn("_b", begin)
        stretch = F.sequence(F.col("_b").cast("int"), (F.col("_b") + F.col("_l") - 1).cast("int"))
        new = cut.select("obj_id", F.explode(stretch).alias("feat_id"))
        # the next segment reads these twice; without the cut the plan would double with every segment
        gaps = checkpointed(new if gaps is None else gaps.union(new))
    marked = cells.join(gaps.withColumn("_x", F.lit(True)), ["obj_id", "feat_id"], "left")
    hit = F.col("_x").isNotNull()
    out = marked.withColumns({"y": F.when(hit, 0.0).otherwise(F.col("y")), "w": F.when(hit, 0.0).otherwise(F.col("w"))})
    return out.select(*cells.columns), gaps.withColumn("kind", F.lit("missing"))
