"""Session-level helpers: the shared folder, scratch tables and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

# A table is broadcast only when it is proven to be within both limits.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

# Spark refuses more buckets than this (spark.sql.sources.bucketing.maxBuckets).
MAX_BUCKETS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex[:12]}/{name}"


# databases made by each application, for release()
_scratch: dict[str, list[str]] = {}


class Scratch:
    """A database of managed Parquet tables in the shared folder.

    Tables bucketed on the same keys join without a shuffle. Dropping a table deletes its files.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.db = f"plumbline_{uuid.uuid4().hex[:12]}"
        self.location = f"{shared_dir(spark)}/{self.db}"
        wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = max(1, min(wanted, MAX_BUCKETS))
        spark.sql(f"CREATE DATABASE {self.db} LOCATION '{self.location}'")
        _scratch.setdefault(spark.sparkContext.applicationId, []).append(self.db)

    def put(self, df: DataFrame, name: str, keys: list[str], partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").format("parquet")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.bucketBy(self.buckets, *keys).saveAsTable(f"{self.db}.{name}")
        return self.spark.table(f"{self.db}.{name}")

    def put_spread(self, df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """Like ``put`` for rows that are not yet laid out by key: one shuffle, one file a bucket."""
        return self.put(df.repartition(self.buckets, *keys), name, keys)

    def path(self, name: str) -> str:
        return f"{self.location}/{name}"

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.db}.{name}")


def laid_out(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write a table once, bucketed by its keys; later joins and groupings on all of them need no shuffle.

    The table is in the shared folder until ``release``.
    """
    return Scratch(df.sparkSession, buckets).put_spread(df, "rows", keys)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Whatever is still to be read from them must be written first."""
    for db in _scratch.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def pin_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Run a table that should be small once and mark it for broadcast if it really is.

    At most ``max_rows + 1`` rows reach the driver. A larger table comes back unchanged and
    unhinted, so that its joins shuffle instead.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > max_bytes:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, archive = tempfile.mkstemp(prefix="plumbline-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def arrow_map(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``mapInArrow`` with the package made available to the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)
