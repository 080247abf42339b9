"""What the operators of this subpackage share: reading, stored steps, Arrow batches, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.runtime import arrow_map, scratch_path

#: Rows and bytes of one Arrow batch, so that a worker's memory is bounded whatever the texts' lengths.
BATCH_ROWS = 2_000
BATCH_BYTES = "8m"

_stored: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batched(df: DataFrame, f, schema) -> DataFrame:
    """``mapInArrow`` over batches of bounded size."""
    small_batches(df.sparkSession)
    return arrow_map(df, f, schema)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: the lineage ends there, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _stored.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the stored steps of this application. Whatever is still to be read from them must be written first."""
    jvm = spark.sparkContext._jvm
    for path in _stored.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path).getParent()
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (a, b) but the roots, the smallest node it is connected to.

    Large and small stars by turns: every node hands its neighbours to the smallest of them. Minima
    are added up before the shuffle and joined from a stored table, so that a node with very many
    links is split like any skewed join. Ends when a round changes nothing.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before, now = None, _state(e)
    while now != before and now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        before, now = now, _state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
