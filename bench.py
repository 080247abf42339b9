"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline import Cauchy, ModelSpec, workload  # noqa: E402
from plumbline.plans.fit import FittedModel, Settings, fit_many  # noqa: E402
from plumbline.plans.score import score  # noqa: E402
from plumbline.runtime import laid_out, release  # noqa: E402
from plumbline.workload.inputs import price_objects  # noqa: E402

HEADLINE = [
    "cells_prepare", "a_step_rank1", "g_step_rank1", "robust_weights", "object_scores", "cv_metrics", "residual_summary",
    "weight_quantiles", "ellipse_bins", "train_split", "cross_bin_consistency", "dual_bin_summary", "metric_agreement",
    "gap_chunks", "low_weight_runs", "range_match_lines", "dedupe_lines", "inject_spikes", "f1_cell",
    "infer_fixed_basis", "score_objects", "score_stream_available", "robust_fit_rank1", "robust_fit_rank2", "robust_fit_rank3",
    "grid_fit", "pca_baseline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(f) -> float:
        t = time.perf_counter()
        f()
        return round(time.perf_counter() - t, 3)

    # start the Python workers and load the classes before the clock runs
    workload.QUERIES["infer_fixed_basis"](spark, sf_dir).count()
    queries = {}
    for name in HEADLINE:
        queries[name] = timed(lambda: workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())

    # one cycle of a fit and the scoring rate, on the supplier matrix
    from pyspark.sql import functions as F

    objects = laid_out(price_objects(spark, sf_dir).withColumn("grp", F.lit(0)), ["grp", "obj_id"])
    n, steps = objects.count(), 6
    total = timed(lambda: fit_many(objects, [ModelSpec("m", 5, Cauchy(3.0))], Settings(conv="none", max_iter=steps), ready=True))
    rng = np.random.default_rng(0)
    model = FittedModel(spark, ModelSpec("m", 5, Cauchy(3.0)), rng.normal(size=(84, 5)))
    rate = timed(lambda: score(objects.select("obj_id", "y", "w"), model).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_headline_seconds",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "fit_seconds_per_cycle": round(total / (steps + 2), 3),
        "objects_scored_per_second": round(n / rate, 1),
    }))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
