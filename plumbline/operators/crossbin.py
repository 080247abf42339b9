"""Reconciling the verdicts of overlapping bins, and comparing selection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.ranks import quantiles


def bins_flagged(members: DataFrame, outliers: DataFrame) -> DataFrame:
    """(obj_id, n_member, n_flagged): in how many bins an object is, and in how many it is flagged.

    Counting replaces the comparison of sets: an object is flagged in all its bins exactly when
    the two counts agree. One shuffle on obj_id of partially aggregated counts.
    """
    tagged = members.select("obj_id", "bin", F.lit(1).alias("m"), F.lit(0).alias("f")).unionByName(
        outliers.select("obj_id", "bin", F.lit(0).alias("m"), F.lit(1).alias("f"))
    )
    # once a (object, bin), so that repeated rows count once, and only bins the object is in
    pairs = tagged.groupBy("obj_id", "bin").agg(F.max("m").alias("m"), F.max("f").alias("f"))
    return pairs.groupBy("obj_id").agg(F.sum("m").alias("n_member"), F.sum(F.col("m") * F.col("f")).alias("n_flagged"), F.max("f").alias("any"))


def consistency(members: DataFrame, outliers: DataFrame) -> DataFrame:
    """Of the flagged objects in more than one bin, how many are flagged in all and in only some."""
    c = bins_flagged(members, outliers).filter("any = 1")
    multi, full = F.col("n_member") > 1, F.col("n_flagged") >= F.col("n_member")
    return c.agg(
        F.count(F.lit(1)).alias("n_outlier_objects"),
        F.count_if(multi).alias("n_multi"),
        F.count_if(multi & full).alias("n_all"),
        F.count_if(multi & ~full).alias("n_some"),
    )


def inconsistent(members: DataFrame, outliers: DataFrame) -> DataFrame:
    """Objects in several bins that are flagged in some of them but not all."""
    return bins_flagged(members, outliers).filter("any = 1 AND n_member > 1 AND n_flagged < n_member").select("obj_id")


def drop_inconsistent(rows: DataFrame, members: DataFrame, outliers: DataFrame) -> DataFrame:
    return rows.join(inconsistent(members, outliers), "obj_id", "left_anti")


def dual_scores(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Objects in exactly two bins with both scores side by side, the lower bin first."""
    both = scores.groupBy("obj_id").agg(
        F.count_distinct("bin").alias("n"),
        F.min(F.struct("bin", "score")).alias("a"),
        F.max(F.struct("bin", "score")).alias("b"),
    )
    pair = both.filter("n = 2").select(
        "obj_id",
        F.col("a.bin").alias("bin_a"),
        F.col("a.score").alias("score_a"),
        F.col("b.bin").alias("bin_b"),
        F.col("b.score").alias("score_b"),
    )
    return pair.withColumns({
        "delta": F.abs(F.col("score_a") - F.col("score_b")),
        "outlier_a": F.col("score_a") < threshold,
        "outlier_b": F.col("score_b") < threshold,
    })


def agreement_class() -> Column:
    a, b = F.col("outlier_a"), F.col("outlier_b")
    return F.when(a & b, "both").when(a | b, "one").otherwise("neither")


def dual_summary(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row a class (all, both, one, neither): counts, spread of the score difference, and for
    objects flagged once how near the other bin's score was to the threshold."""
    labelled = pairs.withColumn("cls", agreement_class())
    rows = labelled.unionByName(labelled.withColumn("cls", F.lit("all")))
    other = F.when(F.col("cls") == "one", F.when(F.col("outlier_a"), F.col("score_b")).otherwise(F.col("score_a")))
    rows = rows.withColumn("other", other)
    near = F.abs(F.col("other") - F.lit(threshold))
    sums = rows.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("delta").alias("mean_delta"),
        F.max("delta").alias("max_delta"),
        F.avg(F.least("score_a", "score_b")).alias("mean_min_score"),
        F.avg(F.greatest("score_a", "score_b")).alias("mean_max_score"),
        F.avg("other").alias("other_mean"),
        F.avg(F.when(F.col("other").isNotNull(), (near < 0.1).cast("double"))).alias("other_within_01"),
        F.avg(F.when(F.col("other").isNotNull(), (near < 0.2).cast("double"))).alias("other_within_02"),
    )
    deltas = quantiles(rows, "delta", {"median_delta": 0.5, "p90_delta": 0.9}, ("cls",))
    others = quantiles(rows, "other", {"other_median": 0.5}, ("cls",))
    return sums.join(deltas, "cls").join(others, "cls", "left")


def dual_status(pairs: DataFrame) -> DataFrame:
    """(obj_id, status) for objects flagged in at least one of their two bins: both or one."""
    return pairs.select("obj_id", agreement_class().alias("status")).filter("status <> 'neither'")


def annotate_dual(outliers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Outlier rows with ``dual_bin``, ``outlier_in_both`` and, for the latter, the ``other_bin``."""
    p = pairs.select("obj_id", "bin_a", "bin_b", (F.col("outlier_a") & F.col("outlier_b")).alias("_both"))
    joined = outliers.join(p, "obj_id", "left")
    both = F.coalesce("_both", F.lit(False))
    other = F.when(F.col("bin") == F.col("bin_a"), F.col("bin_b")).when(F.col("bin") == F.col("bin_b"), F.col("bin_a"))
    return joined.withColumns({
        "dual_bin": F.col("bin_a").isNotNull(), "outlier_in_both": both, "other_bin": F.when(both, other)
    }).drop("bin_a", "bin_b", "_both")


def with_status(outliers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Only the outliers of two-bin objects, each with its status."""
    return outliers.join(dual_status(pairs), "obj_id")


def lookup(outliers: DataFrame, catalogue: DataFrame, scores: DataFrame) -> DataFrame:
    """Outlier rows with catalogue columns and their score in that bin; unmatched ones stay, with nulls."""
    known = outliers.drop("score").join(catalogue, "obj_id", "left")
    return known.join(scores.select("bin", "obj_id", "score"), ["bin", "obj_id"], "left")


def metric_summary(outliers: DataFrame, best: DataFrame) -> DataFrame:
    """A metric's flagged rows, distinct objects, and best rank of every bin as a string."""
    counts = outliers.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_outliers"), F.count_distinct("obj_id").alias("n_objects")
    )
    # bins are few: one row a bin and metric
    ks = best.groupBy("metric").agg(F.sort_array(F.collect_list(F.struct("bin", "best_k"))).alias("t"))
    text = F.concat_ws(",", F.transform("t", lambda x: x["best_k"].cast("string")))
    zero = F.lit(0).cast("bigint")
    return ks.select("metric", text.alias("best_ks")).join(counts, "metric", "full").select(
        "metric", F.coalesce("n_outliers", zero).alias("n_outliers"), F.coalesce("n_objects", zero).alias("n_objects"), "best_ks"
    )


def metric_bin_counts(outliers: DataFrame) -> DataFrame:
    return outliers.groupBy("metric", "bin").agg(F.count(F.lit(1)).alias("n_outliers"))


def agreement(outliers: DataFrame, metrics: list[str]) -> DataFrame:
    """Percentage of a metric's flagged objects that another metric flags too, for every ordered pair.

    One flag a metric and object, then one sum a pair: no join of the table with itself.
    """
    flags = outliers.groupBy("obj_id").agg(*[F.max((F.col("metric") == m).cast("int")).alias(f"f{i}") for i, m in enumerate(metrics)])
    pairs = [(i, j) for i in range(len(metrics)) for j in range(len(metrics))]
    sums = flags.agg(*[F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"s_{i}_{j}") for i, j in pairs])
    rows = F.array(*[
        F.struct(
            F.lit(metrics[i]).alias("metric"),
            F.lit(metrics[j]).alias("other"),
            F.col(f"s_{i}_{j}").alias("n_shared"),
            F.try_divide(F.lit(100.0) * F.col(f"s_{i}_{j}"), F.col(f"s_{i}_{i}")).alias("percent"),
        )
        for i, j in pairs
    ])
    return sums.select(F.inline(rows)).filter("percent IS NOT NULL")


def shared_objects(outliers: DataFrame, metric: str, other: str) -> DataFrame:
    """Objects flagged under both metrics."""
    ids = lambda m: outliers.filter(F.col("metric") == m).select("obj_id")
    return ids(metric).intersect(ids(other))


def combine(parts: list[DataFrame]) -> DataFrame:
    """All bins' outliers in one table, columns matched by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def outlier_table(outliers: DataFrame, pairs: DataFrame, embedding: DataFrame, sort_by: str = "e1") -> DataFrame:
    """Lookup table of outliers: embedding, bin, score and two-bin flags, sorted."""
    rows = annotate_dual(outliers, pairs).join(embedding, ["bin", "obj_id"], "left")
    return rows.select(*embedding.drop("bin", "obj_id").columns, "obj_id", "bin", "score", "dual_bin", "outlier_in_both", "other_bin").orderBy(
        sort_by, "bin", "obj_id"
    )


def mark_train(outliers: DataFrame, split: DataFrame, keys: tuple[str, ...] = ("bin", "obj_id")) -> DataFrame:
    """Add ``in_train``: whether the row's keys are among those of the training split."""
    train = split.filter("in_train").select(*keys).withColumn("_t", F.lit(True))
    return outliers.join(train, list(keys), "left").withColumn("in_train", F.col("_t").isNotNull()).drop("_t")

