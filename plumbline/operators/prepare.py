"""From raw measurements to the two layouts the library works on.

cells    one row a measured cell: (keys..., obj_id, feat_id, y, w); w = 0 means missing
objects  one row an object:       (keys..., obj_id, y ARRAY<DOUBLE>, w ARRAY<DOUBLE>)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import measure


def prepare_cells(df: DataFrame, y: str = "y", sigma: str = "sigma") -> DataFrame:
    """Turn value and uncertainty into value and weight; a missing cell gets 0 for both."""
    return prepare_weighted(df.withColumn("w", measure.inverse_variance(F.col(sigma))).drop(sigma), y, "w")


def prepare_weighted(df: DataFrame, y: str = "y", w: str = "w") -> DataFrame:
    yc, wc = F.col(y), F.col(w)
    return df.withColumns({y: measure.zero_if_missing(yc, yc, wc), w: measure.zero_if_missing(wc, yc, wc)})


def prepare_objects(df: DataFrame, y: str = "y", sigma: str = "sigma") -> DataFrame:
    """The same rule on array columns."""
    cells = F.transform(
        F.arrays_zip(F.col(y).alias("y"), F.col(sigma).alias("s")),
        lambda c: F.struct(c["y"].cast("double").alias("y"), measure.inverse_variance(c["s"].cast("double")).alias("w")),
    )
    return df.withColumns({
        y: F.transform(cells, lambda c: measure.zero_if_missing(c["y"], c["y"], c["w"])),
        "w": F.transform(cells, lambda c: measure.zero_if_missing(c["w"], c["y"], c["w"])),
    }).drop(sigma)


def _edges(clip: int | tuple[int, int]) -> tuple[int, int]:
    left, right = (clip, clip) if isinstance(clip, int) else clip
    if left < 0 or right < 0:
        raise ValueError("clip must not be negative")
    return left, right


def clip_cells(cells: DataFrame, n_features: int, clip: int | tuple[int, int]) -> DataFrame:
    """Drop edge features and renumber the rest from zero. A clip of 0 keeps everything."""
    left, right = _edges(clip)
    kept = cells.filter(F.col("feat_id").between(left, n_features - right - 1))
    return kept.withColumn("feat_id", (F.col("feat_id") - left).cast("int"))


def clip_arrays(objects: DataFrame, clip: int | tuple[int, int], columns: tuple[str, ...] = ("y", "w")) -> DataFrame:
    left, right = _edges(clip)
    return objects.withColumns({c: F.slice(F.col(c), left + 1, F.size(c) - left - right) for c in columns})


def feature_axis(spark: SparkSession, start: float, stop: float, n: int, clip: int | tuple[int, int] = 0) -> DataFrame:
    """Evenly spaced axis with both ends included: (feat_id, x)."""
    step = (stop - start) / (n - 1)
    axis = spark.range(n).select(F.col("id").cast("int").alias("feat_id"), (F.lit(start) + F.col("id") * F.lit(step)).alias("x"))
    return clip_cells(axis, n, clip)


def cells_to_objects(cells: DataFrame, n_features: int, keys: tuple[str, ...] = ("obj_id",)) -> DataFrame:
    """Gather each object's cells into dense arrays; cells that are not there are missing, and a feature outside
    0 .. n_features - 1 is an error.

    One shuffle on the keys. A group is one object, so it holds at most ``n_features`` cells.
    """
    stray = F.count_if((F.col("feat_id") < 0) | (F.col("feat_id") >= n_features))
    held = F.map_from_entries(F.collect_list(F.struct("feat_id", F.struct("y", "w").alias("c"))))
    table = F.when(stray > 0, F.raise_error(F.lit(f"a feat_id is outside 0 .. {n_features - 1}"))).otherwise(held)
    feats = F.sequence(F.lit(0), F.lit(n_features - 1))
    zero = F.lit(0.0)
    gathered = cells.withColumn("feat_id", F.col("feat_id").cast("int")).groupBy(*keys).agg(table.alias("t"))
    return gathered.select(
        *keys,
        F.transform(feats, lambda j: F.coalesce(F.try_element_at("t", j)["y"], zero)).alias("y"),
        F.transform(feats, lambda j: F.coalesce(F.try_element_at("t", j)["w"], zero)).alias("w"),
    )


def objects_to_cells(objects: DataFrame, columns: tuple[str, ...] = ("y", "w"), keys: tuple[str, ...] = ("obj_id",)) -> DataFrame:
    """One row a cell, missing cells included. Narrow."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in columns])
    return objects.select(*keys, F.posexplode(zipped).alias("feat_id", "c")).select(
        *keys, "feat_id", *[F.col(f"c.{c}").alias(c) for c in columns]
    )


def quality_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows, and for each column how many values are null, NaN or infinite: one pass."""

    def count(cond: Column) -> Column:
        return F.count_if(cond)

    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [
            count(x.isNull()).alias(f"{c}_null"),
            count(x.isNotNull() & F.isnan(x)).alias(f"{c}_nan"),
            count(x.isNotNull() & ~F.isnan(x) & (F.abs(x) == float("inf"))).alias(f"{c}_inf"),
        ]
    return df.agg(*aggs)
