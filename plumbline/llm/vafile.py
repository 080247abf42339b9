"""Exact top-k inner products over a vector-approximation file.

Every component is cut into cells of equal width; a vector's approximation is its cell numbers, a byte each. A
query scans all approximations. The cells bound the inner product: the product with the cells' middles, plus or
minus the sum of |query component| * half a cell. A scan keeps the k largest lower bounds seen
so far and what can still beat them. Then exact vectors are read in order of their bounds: first the k most
promising of a query; their kth score settles which of the rest must be read at all, and with these the kth
result is certain.

Queries go in waves of bounded size, each sent to all tasks; equal vectors are one entry of the file.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import batched, stored, table
from plumbline.llm.vectors import best, classes, entries_for, matrix, valid

K = 5
#: Queries scanned for together; the driver and every worker hold this many.
WAVE = 4_096
CELLS = 256
#: Candidates that a task holds; beyond that they go out early, and are sifted later like all.
HELD = 2_000_000
#: Scores of a block of queries with a block of approximations that are held at once.
BLOCK = 1 << 21


def _approximate(low: np.ndarray, width: np.ndarray):
    def run(batches):
        for b in batches:
            codes = np.clip(np.floor((matrix(b.column(1)) - low) / width), 0, CELLS - 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["first", "code"])

    return run


_BOUNDS = "query_id long, vec_id long, low double, high double"


def _scan(sent, low: np.ndarray, width: np.ndarray, k: int):
    """Of every query the approximations whose upper bound reaches the kth largest lower bound of this task."""

    def run(batches):
        ids, queries = sent.value
        half = np.abs(queries) @ (width / 2)
        kept = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0)) for _ in ids]  # vec, low, high
        sure = np.full(len(ids), -np.inf)  # kth largest lower bound so far
        held = 0

        def flush():
            for q, (vec, lows, highs) in enumerate(kept):
                if len(vec):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vec), ids[q])), pa.array(vec), pa.array(lows), pa.array(highs)], ["query_id", "vec_id", "low", "high"])
                    kept[q] = (vec[:0], lows[:0], highs[:0])

        for b in batches:
            first = b.column(0).to_numpy()
            codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(first), -1)
            middles = low + (codes + 0.5) * width
            step = max(1, BLOCK // max(1, len(first)))
            for lo in range(0, len(ids), step):
                scores = queries[lo : lo + step] @ middles.T
                if scores.shape[1] >= k:
                    here = np.partition(scores, -k, axis=1)[:, -k] - half[lo : lo + step]
                    sure[lo : lo + step] = np.maximum(sure[lo : lo + step], here)
                for i in range(len(scores)):
                    q, h = lo + i, half[lo + i]
                    near = np.flatnonzero(scores[i] + h >= sure[q])
                    if not len(near):
                        continue
                    vec, lows, highs = kept[q]
                    held -= len(vec)
                    vec = np.concatenate([vec, first[near]])
                    lows = np.concatenate([lows, scores[i, near] - h])
                    highs = np.concatenate([highs, scores[i, near] + h])
                    if len(lows) > k:
                        sure[q] = max(sure[q], np.partition(lows, -k)[-k])
                        still = highs >= sure[q]
                        vec, lows, highs = vec[still], lows[still], highs[still]
                    held += len(vec)
                    kept[q] = vec, lows, highs
            if held > HELD:
                yield from flush()
                held = 0
        yield from flush()

    return run


def _exact(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, score, ids): the exact vectors of pairs are read and multiplied; of a query id's several vectors the best counts."""
    product = F.expr("aggregate(zip_with(qv, v, (a, b) -> a * b), 0L, (s, x) -> s + x)")
    found = pairs.select("query_id", "vec_id").join(vectors.select(F.col("first").alias("vec_id"), "v", "ids"), "vec_id")
    found = found.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    found = found.select("query_id", "vec_id", product.alias("score"), "ids")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))


def search(rows: DataFrame, queries: DataFrame, k: int = K, wave: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query with all rows but those of its own id.

    ``rows`` and ``queries`` are (id, v) with v an array of longs; products must stay within 2**53. Ties go to the
    smaller id. Equal rows count once; a query id with several vectors takes the best of them. Fewer
    candidates than k give them all; empty tables give no rows.
    """
    spark = rows.sparkSession
    n = entries_for(rows, k)  # some entries may be the query itself, or one id again
    # doubles hold the whole numbers exactly
    vectors = classes(rows, k + 1)
    queries = stored(queries.select("id", "v").distinct(), "queries")
    ends = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("d").collect()
    low = np.array([r["a"] for r in ends], np.float64)
    width = np.maximum(np.array([r["b"] for r in ends], np.float64) - low, 1.0) / CELLS * (1 + 1e-9)
    doubles = vectors.select("first", F.col("v").cast("array<double>").alias("v"))
    file = stored(batched(doubles, _approximate(low, width), "first long, code binary"), "approximations")
    waves = max(1, ceil(queries.count() / wave))
    parts = []
    for i in range(waves):
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == i).toArrow()
        if mine.num_rows:
            vs = matrix(mine["v"].combine_chunks(), np.float64)
            sent = spark.sparkContext.broadcast((mine["id"].to_numpy(), vs))
            parts.append(stored(batched(file, _scan(sent, low, width, n), _BOUNDS), "bounds"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bounds = parts[0]
    for more in parts[1:]:
        bounds = bounds.unionByName(more)
    bounds = bounds.groupBy("query_id", "vec_id").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    sure = best(bounds, F.col("low"), n).groupBy("query_id").agg(F.min("low").alias("limit"), F.count("*").alias("n"))
    sure = stored(sure.select("query_id", F.when(F.col("n") >= n, F.col("limit")).otherwise(F.lit(float("-inf"))).alias("limit")), "limits")
    left = stored(best(bounds.join(sure, "query_id").where("high >= limit"), F.col("high"), 1 << 30, "turn").select("query_id", "vec_id", "high", "turn"), "candidates")
    first = stored(_exact(left.where(F.col("turn") <= n), vectors, queries), "first")
    settled = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    settled = stored(settled.select("query_id", F.when(F.col("n") >= n, F.col("least")).alias("least")), "settled")
    rest = left.where(F.col("turn") > n).join(settled, "query_id").where("least IS NULL OR high >= least - 0.5")
    found = first.unionByName(_exact(rest, vectors, queries))
    found = best(found, F.col("score"), n, "place").select("query_id", "score", F.explode("ids").alias("vec_id"))
    found = found.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best(found, F.col("score"), k).select("query_id", "rank", "vec_id", "score")


def op7_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every 50th vector of ``embeddings``."""
    rows = valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    whole = rows.select("id", F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("v"))
    return search(whole, whole.where(F.col("id") % 50 == 0))
