"""Reading inputs, and the tables a run leaves behind.

A store is a folder of Parquet tables. Model tables are partitioned by ``model_id``, results of
the population pipeline by ``metric`` and ``bin``, so that a reader touches only what it asks for.
"""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass
from importlib import import_module
from inspect import signature

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.losses import Loss
from plumbline.plans.fit import FittedModel, ModelSpec, coefficient_table
from plumbline.runtime import pin_small

CATALOGUE_SCHEMA = "obj_id bigint, parallax double, colour double, magnitude double"
LINE_SCHEMA = "species string, x double"
BAND_SCHEMA = "species string, x_start double, x_end double"
# Line lists in order of precedence. Fixed values.
LINE_LISTS = ("strong", "abundance", "diffuse")
BAND_LIST = "bands"

MODEL_SCHEMA = "model_id string, grp int, k int, q2 double, n_iter int, converged boolean, loss double, family string, parameters string, ridge double"
# A bin is written to this part of as many files as a shuffle has partitions.
FILES_SHARE = 4
# Rows of a model's coefficients that one file holds on average.
FILE_ROWS = 1 << 20
TABLES = ("outliers", "object_scores", "bin_summary", "outlier_vectors", "residuals")


def read_catalogue(spark: SparkSession, path: str, schema: str = CATALOGUE_SCHEMA, drop_null: bool = True, positive_parallax: bool = True) -> DataFrame:
    """Object catalogue from CSV with a header: four columns, complete rows, positive parallaxes.

    Columns are matched to the file's by name, whatever else the file holds.
    """
    names = [part.split()[0] for part in schema.split(",")]
    types = dict(part.split() for part in schema.split(","))
    header = spark.read.option("header", True).csv(path)
    df = header.select(*[F.col(n).try_cast(types[n]).alias(n) for n in names])
    if drop_null:
        df = df.dropna()
    if positive_parallax:
        df = df.filter(F.col("parallax") > 0)
    return df


def read_objects(spark: SparkSession, path: str, ids: DataFrame | None = None, columns: tuple[str, ...] = ("obj_id", "y", "sigma")) -> DataFrame:
    """Array rows from Parquet, optionally only the objects in ``ids``."""
    df = spark.read.parquet(path).select(*columns)
    return df if ids is None else df.join(ids.select("obj_id"), "obj_id", "left_semi")


def match_catalogue(objects: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Objects that have a catalogue row, with its columns."""
    return objects.join(catalogue, "obj_id", "inner")


def read_lines(spark: SparkSession, folder: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """The line lists as one table (list_no, pos, species, x) in order of precedence, and the bands.

    ``pos`` rises with the place of the line in its file. A list is one file; a list of several has no order and
    is an error, unless it comes in ``parts``: then its files are one list in the order of their names, as Spark numbers what it writes.
    """
    lists = []
    for no, name in enumerate(LINE_LISTS):
        # multiLine: a file is read whole by one task, in its order
        df = spark.read.schema(LINE_SCHEMA).option("header", True).option("multiLine", True).csv(f"{folder}/{name}.csv")
        files = df.inputFiles()
        pos = F.monotonically_increasing_id()
        if len(files) > 1:
            if not parts:
                raise ValueError(f"the line list {name} has more than one file")
            # the lower 33 bits of the id rise along the rows of a task, so along a file, wherever it is read
            rows = df.select("species", "x", F.col("_metadata.file_name").alias("_file"), pos.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
            order = spark.createDataFrame(list(enumerate(sorted(f.rsplit("/", 1)[-1] for f in files))), "_no long, _file string")
            df, pos = rows.join(F.broadcast(order), "_file"), F.shiftleft("_no", 33) + F.col("_row")
        lists.append(df.select(F.lit(no).alias("list_no"), pos.alias("pos"), "species", "x"))
    lines = lists[0]
    for p in lists[1:]:
        lines = lines.unionByName(p)
    return lines, spark.read.schema(BAND_SCHEMA).option("header", True).csv(f"{folder}/{BAND_LIST}.csv")


def loss_record(loss: Loss) -> tuple[str, str]:
    """Where the class of a loss is and its parameters, as JSON."""
    if not is_dataclass(loss):
        raise ValueError(f"{type(loss).__name__} can't be stored; a loss is stored as a dataclass of its parameters")
    kind = type(loss)
    if "<locals>" in kind.__qualname__ or kind.__module__ == "__main__":
        raise ValueError(f"{kind.__qualname__} can't be stored; its class must be at the top of a module")
    taken = signature(kind).parameters
    return f"{kind.__module__}:{kind.__qualname__}", json.dumps({k: v for k, v in asdict(loss).items() if k in taken})


def loss_from(family: str, parameters: str) -> Loss:
    module, _, name = family.partition(":")
    return getattr(import_module(module), name)(**json.loads(parameters))


class ModelStore:
    """Fitted models: ``models`` (one row each), ``basis`` (a row a feature), ``coeffs`` (a row an object)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, df: DataFrame, table: str) -> None:
        # replaces the partitions it writes and leaves the other models alone
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(f"{self.path}/{table}")

    def save(self, model: FittedModel) -> None:
        self.save_many([model])

    def save_many(self, models: list[FittedModel], coeffs: DataFrame | None = None) -> None:
        """One write a table for all models together; ``coeffs(model_id, obj_id, a)`` stands in for their own."""
        if not models:
            return
        if coeffs is None:
            coeffs = coefficient_table(models)
        if coeffs is not None:
            # a model's rows over as many files as their number asks for, but not a file a model from every task
            files = coeffs.groupBy("model_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(FILE_ROWS)).alias("_files"))
            dealt = coeffs.join(pin_small(files), "model_id").withColumn("_file", F.pmod(F.xxhash64("obj_id"), F.col("_files")))
            self._write(dealt.repartition("model_id", "_file").drop("_files", "_file"), "coeffs")
        basis = [(m.model_id, j, [float(x) for x in row]) for m in models for j, row in enumerate(m.g)]
        self._write(self.spark.createDataFrame(basis, "model_id string, feat_id int, g array<double>"), "basis")
        rows = [
            (m.model_id, m.spec.grp, m.k, float(getattr(m.loss, "q2", float("inf"))), m.n_iter, m.converged, float(m.loss_history[-1]) if m.loss_history else None)
            + (*loss_record(m.loss), m.ridge)
            for m in models
        ]
        # the registry last: a model listed there is complete
        self._write(self.spark.createDataFrame(rows, MODEL_SCHEMA), "models")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def models(self) -> DataFrame:
        return self._read("models")

    def coeffs(self, model_id: str) -> DataFrame:
        return self._read("coeffs").filter(F.col("model_id") == model_id).drop("model_id")

    def basis(self, model_id: str) -> DataFrame:
        return self._read("basis").filter(F.col("model_id") == model_id).select("feat_id", "g")

    def has(self, model_id: str) -> bool:
        try:
            return not self.models().filter(F.col("model_id") == model_id).isEmpty()
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise

    def load(self, model_id: str, with_coeffs: bool = True) -> FittedModel:
        r = self.models().filter(F.col("model_id") == model_id).first()
        if r is None:
            raise KeyError(model_id)
        # the basis is one row a feature, bounded by what the fit itself holds on the driver
        rows = self.basis(model_id).orderBy("feat_id").collect()
        spec = ModelSpec(model_id, r["k"], loss_from(r["family"], r["parameters"]), r["grp"])
        coeffs = self.coeffs(model_id) if with_coeffs else None
        history = [r["loss"]] if r["loss"] is not None else []
        return FittedModel(self.spark, spec, np.array([x["g"] for x in rows]), coeffs, history, r["n_iter"], r["converged"], r["ridge"])

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Rows of a requested grid whose ``model_id`` is not in the registry yet."""
        try:
            return wanted.join(self.models().select("model_id"), "model_id", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return wanted
            raise

    def cached_coeffs(self, model: FittedModel, objects: DataFrame, **options) -> DataFrame:
        """The model's coefficients of ``objects``: stored ones where there are, the others inferred and stored too."""
        key = f"{model.model_id}/all"
        known = self.has(key)
        new = objects.join(self.coeffs(key).select("obj_id"), "obj_id", "left_anti") if known else objects
        if not known or not new.isEmpty():
            inferred = model.infer(new, **options).select("obj_id", "a")
            if known:
                inferred.withColumn("model_id", F.lit(key)).write.mode("append").partitionBy("model_id").parquet(f"{self.path}/coeffs")
            else:
                self.save(FittedModel(self.spark, ModelSpec(key, model.k, model.loss, model.spec.grp), model.g, inferred, ridge=model.ridge))
        return self.coeffs(key).join(objects.select("obj_id").distinct(), "obj_id", "left_semi")


class ResultStore:
    """Per-bin results of the population pipeline, partitioned by metric and bin."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, table: str, df: DataFrame) -> None:
        if table not in TABLES:
            raise ValueError(f"table must be one of {TABLES}, got {table!r}")
        if "obj_id" in df.columns:
            # a bin's rows over several files, however large the bin, but not a file a bin from every task
            files = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // FILES_SHARE)
            df = df.repartition("metric", "bin", F.pmod(F.hash("obj_id"), F.lit(files)))
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric", "bin").parquet(f"{self.path}/{table}")

    def read(self, table: str, metric: str | None = None, bin: int | None = None) -> DataFrame:
        """A result table; the filters pick partitions."""
        df = self.spark.read.parquet(f"{self.path}/{table}")
        if metric is not None:
            df = df.filter(F.col("metric") == metric)
        if bin is not None:
            df = df.filter(F.col("bin") == bin)
        return df

    def available_bins(self, metric: str) -> DataFrame:
        return self.read("bin_summary", metric).select("bin").distinct()
