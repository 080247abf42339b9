"""Overlapping population bins on a two-axis catalogue, and picks of objects within them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions import draws
from plumbline.operators.ranks import numbered
from plumbline.runtime import pin_small


@dataclass(frozen=True)
class BinGeometry:
    """Evenly spaced elliptical bins whose y centres follow a Gaussian bump. Defaults are fixed values."""

    n: int = 14
    x_min: float = -0.1
    x_max: float = 3.0
    y_min: float = 0.0
    y_max: float = 11.0
    x_width_factor: float = 1.5
    y_width_factor: float = 2.8
    bump_centre: float = 1.5
    bump_sigma: float = 0.6
    bump_height: float = 1.5

    @property
    def x_width(self) -> float:
        return (self.x_max - self.x_min) / (self.n - 1) * self.x_width_factor

    @property
    def y_width(self) -> float:
        return (self.y_max - self.y_min) / (self.n - 1) * self.y_width_factor


def bin_table(spark: SparkSession, geo: BinGeometry) -> DataFrame:
    """(bin, cx, cy, wx, wy), one row a bin."""
    at = F.col("id") / F.lit(float(geo.n - 1))
    table = spark.range(geo.n).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(geo.x_min) + at * F.lit(geo.x_max - geo.x_min)).alias("cx"),
        (F.lit(geo.y_min) + at * F.lit(geo.y_max - geo.y_min)).alias("base"),
        F.lit(geo.x_width).alias("wx"),
        F.lit(geo.y_width).alias("wy"),
    )
    off = (F.col("cx") - F.lit(geo.bump_centre)) / F.lit(geo.bump_sigma)
    bump = F.lit(geo.bump_height) * F.exp(F.lit(-0.5) * off * off)
    return table.select("bin", "cx", (F.col("base") + bump).alias("cy"), "wx", "wy")


def bin_members(objects: DataFrame, bins: DataFrame, x: str = "x", y: str = "y", grid: float | None = None) -> DataFrame:
    """All (bin, object) pairs with the object strictly inside the bin's ellipse; an object may be in several.

    The inequality becomes an equality on a grid along x: a bin is listed in every grid cell it
    touches, an object in its own, and the ellipse is tested on the matches. The bins are
    broadcast when proven small, else both sides shuffle on the grid cell.
    """
    if grid is None:
        grid = bins.agg(F.max("wx")).first()[0]
    step = F.lit(float(grid))
    half = F.col("wx") / 2
    listed = bins.withColumn("_g", F.explode(F.sequence(
        F.floor((F.col("cx") - half) / step), F.floor((F.col("cx") + half) / step)
    )))
    here = objects.withColumn("_g", F.floor(F.col(x) / step))
    dx = (F.col(x) - F.col("cx")) / (F.col("wx") / 2)
    dy = (F.col(y) - F.col("cy")) / (F.col("wy") / 2)
    found = here.join(pin_small(listed), "_g").filter(dx * dx + dy * dy < 1)
    return found.select("bin", *objects.columns)


def bin_counts(members: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """Objects a bin; with the bin table, empty bins count 0."""
    counts = members.groupBy("bin").agg(F.count(F.lit(1)).alias("n_objects"))
    if bins is None:
        return counts
    return bins.select("bin").join(counts, "bin", "left").select("bin", F.coalesce("n_objects", F.lit(0)).alias("n_objects"))


def outlier_fraction(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    low = F.col("score") < threshold
    return scores.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_objects"), F.count_if(low).alias("n_outliers"), F.avg(low.cast("double")).alias("fraction")
    )


# Draws are counted in this many equal slices of [0, 1).
SLICES = 4096


def _smallest_draws(rows: DataFrame, need: Column, seed: int, by: tuple[str, ...], id: str, slices: int) -> DataFrame:
    """Add ``_taken``: whether a row is among its group's ``need`` smallest hash draws; exact.

    ``need`` may use ``_n``, the group's size. The draws are uniform, so the slices are equally
    full. Counting them finds the slice where each group reaches its number, and only that slice is
    ranked: no task sees more than about ``n / slices`` rows of a group.
    """
    u = draws.uniform(seed, *[F.col(c) for c in by], F.col(id))
    drawn = rows.withColumn("_u", u).withColumn("_s", F.floor(F.col("_u") * slices).cast("int"))
    tally = drawn.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_c"))
    tally = tally.withColumns({
        "_before": F.sum("_c").over(Window.partitionBy(*by).orderBy("_s")) - F.col("_c"),
        "_n": F.sum("_c").over(Window.partitionBy(*by)),
    }).withColumn("_need", need)
    # the slice where the number is reached (the smallest one; past the end where all are taken)
    at = F.when(F.col("_before") + F.col("_c") > F.col("_need"), F.struct(F.col("_s"), (F.col("_need") - F.col("_before")).alias("_take")))
    edge = tally.groupBy(*by).agg(F.min(at).alias("_at")).select(
        *by, F.coalesce("_at._s", F.lit(slices)).alias("_edge"), F.coalesce("_at._take", F.lit(0)).alias("_take")
    )
    marked = drawn.join(pin_small(edge), list(by))
    sure = marked.filter("_s <> _edge").withColumn("_taken", F.col("_s") < F.col("_edge"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_u", id))
    edged = marked.filter("_s = _edge").withColumn("_taken", rank <= F.col("_take"))
    keep = [*rows.columns, "_taken"]
    return sure.select(*keep).unionByName(edged.select(*keep))


def split_train(members: DataFrame, fraction: float, seed: int, by: tuple[str, ...] = ("bin",), id: str = "obj_id", slices: int = SLICES) -> DataFrame:
    """Add ``in_train``: exactly ``int(n * fraction)`` objects of each group, drawn by hash."""
    need = F.floor(F.col("_n") * F.lit(float(fraction)))
    return _smallest_draws(members, need, seed, by, id, slices).withColumnRenamed("_taken", "in_train")


def sample_per_group(members: DataFrame, n: int, seed: int, by: tuple[str, ...] = ("bin",), id: str = "obj_id") -> DataFrame:
    """A hash-drawn sample of ``n`` objects a group, all of a smaller one."""
    need = F.least(F.col("_n"), F.lit(n).cast("bigint"))
    return _smallest_draws(members, need, seed, by, id, SLICES).filter("_taken").drop("_taken")


# Up to this rank Spark lets each task pass on its own first rows only (windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def extremes_per_group(scores: DataFrame, n: int, highest: bool = True, by: tuple[str, ...] = ("bin",)) -> DataFrame:
    """The ``n`` least (or most) anomalous objects a group with their ``rank``, ties by id."""
    first = -F.col("score") if highest else F.col("score")
    ranked = scores.withColumn("_o", first)
    if n < GROUP_LIMIT:
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_o", "obj_id")))
    else:
        ranked = numbered(ranked, ["_o", "obj_id"], by).withColumn("rank", (F.col("row_no") + 1).cast("int")).drop("row_no")
    return ranked.filter(F.col("rank") <= n).drop("_o")


def systematic_sample(members: DataFrame, size: int, by: tuple[str, ...] = ("bin",), id: str = "obj_id") -> DataFrame:
    """Every ``n // size``-th object of a group in id order; whole groups of up to ``size``."""
    keys = members.select(*by, id)
    sizes = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(keys, [id], by).join(pin_small(sizes), list(by))
    step = F.greatest(F.floor(F.col("_n") / F.lit(float(size))), F.lit(1))
    return placed.filter(F.col("row_no") % step == 0).drop("_n")
