"""Exact quantiles and ranks over groups of any size.

``percentile`` and a window both bring a whole group to one task. That is right for groups with
a known bound (the cells of one object) and wrong for the cells of one feature or of the whole
table. A larger group is counted by value instead, partially before the shuffle; its distinct values are
spread over ranges, and the ranges' totals tell in which of them a wanted rank lies. Only the values
near a wanted rank are: a sketch brackets it, and exact counts below and within the bracket prove that it is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.runtime import checkpointed, pin_small

# A group of at most this many values is handed to one task.
HOT_ROWS = 1_000_000
# Accuracy of the sketch that brackets a rank, and the share of a group on each side of it that a bracket reaches over.
SKETCH = 10_000
REACH = 0.0005


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: tuple[str, ...] = (),
    max_group: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact linear-interpolation quantiles, one column a probability, nulls left out.

    NaN is the largest value, after infinity, and an interpolation with NaN is NaN, for groups of every size.
    ``max_group`` is the caller's proof that no group is larger; without it the groups are
    counted first and those above ``hot_rows`` are counted by value.
    """
    df = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    direct = [F.percentile(F.col("_v"), F.lit(p)).alias(n) for n, p in probs.items()]
    if max_group is not None and max_group <= hot_rows:
        return df.groupBy(*by).agg(*direct)
    df = checkpointed(df)  # read more than once
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    hot = checkpointed(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(*keys, "_n"))
    if hot.isEmpty():
        return df.groupBy(*by).agg(*direct)
    if not by:
        return _bracketed(df.withColumn("_all", F.lit(0)), hot.withColumn("_k0", F.lit(0)), ("_all",), probs).drop("_all")
    same = _null_safe(by)
    return df.join(hot, same, "left_anti").groupBy(*by).agg(*direct).unionByName(_bracketed(df, hot, by, probs))


def _null_safe(by: tuple[str, ...]):
    """Equality of the keys with their copies _k0, _k1, ..., null equal to null."""
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return out


def _bracketed(df: DataFrame, hot: DataFrame, by: tuple[str, ...], probs: dict[str, float]) -> DataFrame:
    """Quantiles of the groups in ``hot(_k0, ..., _n)``, from the values between two ends that a sketch gives for each rank.

    A group whose exact counts do not have a rank within its bracket, as where NaN upset the sketch, has all its values counted.
    """
    copies = [f"_k{i}" for i in range(len(by))]
    wanted = list(probs.values())
    ends = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in wanted for d in (-REACH, REACH)])
    rows = df.join(pin_small(hot), _null_safe(by))
    sketch = rows.groupBy(*copies, "_n").agg(F.percentile_approx("_v", ends, F.lit(SKETCH)).alias("_ends"))
    sketch = checkpointed(sketch)
    rows = df.join(pin_small(sketch), _null_safe(by))
    at = [F.col("_n").cast("double") - 1.0 for _ in wanted]
    at = [a * F.lit(float(p)) for a, p in zip(at, wanted)]
    inside = [(F.col("_v") >= F.get("_ends", F.lit(2 * i))) & (F.col("_v") <= F.get("_ends", F.lit(2 * i + 1))) for i in range(len(wanted))]
    counts = [f(c).alias(f"{n}{i}") for i in range(len(wanted)) for n, f, c in (
        ("_below", F.count_if, F.col("_v") < F.get("_ends", F.lit(2 * i))), ("_in", F.count_if, inside[i]))]
    held = F.lit(True)
    for i, a in enumerate(at):
        held = held & (F.floor(a) >= F.col(f"_below{i}")) & (F.ceil(a) < F.col(f"_below{i}") + F.col(f"_in{i}"))
    found = checkpointed(rows.groupBy(*copies, "_n", "_ends").agg(*counts).withColumn("_held", held))
    lost = found.filter(~F.col("_held")).select(*copies)
    parts = []
    if not lost.isEmpty():
        parts.append(_by_counts(df.join(lost, _null_safe(by), "left_semi"), by, probs))
    # a row is one of as many brackets as it lies in
    which = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]))
    near = df.join(pin_small(found.filter("_held")), _null_safe(by)).withColumn("_i", F.explode(which))
    below = F.element_at(F.array(*[F.col(f"_below{i}") for i in range(len(wanted))]), F.col("_i") + 1)
    near = near.select(*by, "_i", "_v", "_n", below.alias("_below"))
    keys = (*by, "_i")
    named = F.element_at(F.array(*[F.lit(float(p)) for p in wanted]), F.col("_i") + 1)
    values = _by_counts(near, keys, {"_q": named}, "_n", "_below")
    picked = [F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(probs)]
    parts.append(values.groupBy(*by).agg(*picked))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _by_counts(df: DataFrame, by: tuple[str, ...], probs: dict, total: str | None = None, below: str | None = None) -> DataFrame:
    """Quantiles from the number of rows of every distinct value.

    Rows that are a part of their group bring its size and the number of its rows below them in the columns ``total`` and
    ``below``, constant in a group. A probability may be a column of the group's keys.
    """
    given = [F.first(c).alias(n) for c, n in ((total, "_of"), (below, "_under")) if c]
    counted = df.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"), *given)
    tallies = checkpointed(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    copies = [f"_k{i}" for i in range(len(by))]
    # a row a group and range
    sizes = tallies.groupBy(*keys, F.col("_part").alias("_p")).agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(*copies).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_shift", F.coalesce(F.sum("_s").over(before), F.lit(0))).withColumn("_total", F.sum("_s").over(Window.partitionBy(*copies)))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    rows = tallies.withColumn("_upto", upto).join(sizes, (F.col("_part") == F.col("_p")) & _null_safe(by))
    rows = rows.withColumn("_upto", F.col("_upto") + F.col("_shift"))
    if total:
        rows = rows.withColumn("_upto", F.col("_upto") + F.col("_under")).withColumn("_total", F.col("_of"))
    aggs, out = [], []
    for name, p in probs.items():
        p = p if isinstance(p, Column) else F.lit(float(p))
        at = F.col("_total").cast("double") - 1.0
        at = at * p
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            held = (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n"))
            aggs.append(F.max(F.when(held, F.col("_v"))).alias(f"_{end}_{name}"))
        at = (F.col("_total") - 1.0) * p
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name))
    return rows.groupBy(*by, "_total").agg(*aggs).select(*by, *out)


def numbered(df: DataFrame, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``row_no`` (from 0) in the given order within each group, whatever the group's size.

    Rows are range-partitioned on group and order, so a hot group spreads over many tasks; the
    numbering within a task is shifted by the counts of the tasks before it. The order must be
    total. Pass only the columns that are needed: they are shuffled.
    """
    spread = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    fixed = checkpointed(spread)
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    sizes = fixed.groupBy(*keys, F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(by))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = fixed.withColumn("_row", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    joined = local.join(shifts, (F.col("_part") == F.col("_p")) & _null_safe(by))
    return joined.select(*df.columns, (F.col("_row") - 1 + F.col("_shift")).alias("row_no"))
