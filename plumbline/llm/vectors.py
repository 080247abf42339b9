"""What the two vector searches share: valid rows, classes of equal vectors, Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import stored


def valid(rows: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """id, v (array of doubles) of the rows that take part: an id, and a vector of the table's dimension
    without null or non-finite components; with ``nonzero``, one component at least that is not 0. The dimension is
    the length that most of these vectors have (the larger, if two have as many), so strays do not decide it."""
    rows = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("width")).count()
    width = sizes.agg(F.max_by("width", F.struct("count", "width"))).first()[0]
    return rows.where(F.size("v") == F.lit(width or 0))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """first, v, ids: one row for each distinct vector with its ``keep`` smallest ids.

    No answer of fewer than ``keep`` ids needs more of equal vectors, so that a vector that a third of the
    rows share is one entry. Ids beyond ``keep`` are left out before the shuffle.
    """
    # a row's own hash spreads the copies of a vector, so that no task sorts all ids of one
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    some = Window.partitionBy("v", "part").orderBy("id")
    few = rows.select("id", "v").distinct().withColumn("part", part).withColumn("n", F.row_number().over(some)).where(F.col("n") <= keep)
    per = few.groupBy("v", "part").agg(F.collect_list("id").alias("ids")).groupBy("v").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    ids = F.slice(F.array_sort("ids"), 1, keep)
    return stored(per.select(ids.alias("ids"), "v").select(F.element_at("ids", 1).alias("first"), "v", "ids"), "classes")


def entries_for(rows: DataFrame, k: int) -> int:
    """Best distinct vectors among which there are k ids besides a query's own, if there are so many at all: an id may have several."""
    most = rows.groupBy("id").agg(F.count_distinct(F.xxhash64("v")).alias("n")).agg(F.max("n")).first()[0]
    return k * (most or 1) + 1


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A column of equally long lists."""
    n = len(column)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(kind, copy=False) if n else np.zeros((0, 0), kind)


def best(pairs: DataFrame, score: Column, k: int, rank: str = "rank") -> DataFrame:
    """The k largest scores of every query, ties to the smaller id; Spark keeps k a query and task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(score.desc(), "vec_id")
    return pairs.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)
