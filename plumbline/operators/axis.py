"""Work along a sorted axis: chunks between gaps, smoothed low-weight runs, range matches, near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.operators.ranks import quantiles
from plumbline.runtime import checkpointed, pin_small


def _carried(df: DataFrame, by: tuple[str, ...], x: str, last: str, out: str) -> DataFrame:
    """Add the value of ``last`` from the row before, over slices: within the slice by a window,
    at its start from the nearest earlier slice. A group's rows meet one slice at a time."""
    local = df.withColumn(out, F.lag(last).over(Window.partitionBy(*by, "_slice").orderBy(x)))
    ends = df.groupBy(*by, "_slice").agg(F.max_by(last, x).alias("_end"))
    ends = ends.withColumn("_from", F.lag("_end").over(Window.partitionBy(*by).orderBy("_slice"))).drop("_end")
    return local.join(ends, [*by, "_slice"]).withColumn(out, F.coalesce(out, "_from")).drop("_from")


def _running_sum(df: DataFrame, by: tuple[str, ...], x: str, value: str, out: str) -> DataFrame:
    """Running sum in the same two levels."""
    local = df.withColumn(out, F.sum(value).over(Window.partitionBy(*by, "_slice").orderBy(x)))
    sums = df.groupBy(*by, "_slice").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    return local.join(sums, [*by, "_slice"]).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def gap_chunks(
    df: DataFrame,
    x: str,
    by: tuple[str, ...],
    slice_width: float,
    factor: float = 3.0,
    step: float | None = None,
    max_group: int | None = None,
) -> DataFrame:
    """Split each group's axis where a gap exceeds ``factor * step``; the step defaults to the group's median gap.

    Returns (by..., chunk, x_start, x_end, n). ``slice_width`` cuts the axis into the pieces that
    one task orders, so that a group of any size is spread. Rows at the same place count once as a
    position and in ``n`` as often as they occur.
    """
    at = df.groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    at = at.withColumn("_slice", F.floor(F.col("_x") / F.lit(float(slice_width))))
    rows = _carried(at, by, "_x", "_x", "_prev").withColumn("_gap", F.col("_x") - F.col("_prev"))
    if step is None:
        typical = quantiles(rows, "_gap", {"_step": 0.5}, by, max_group)
        rows = rows.join(pin_small(typical), list(by), "left")
    else:
        rows = rows.withColumn("_step", F.lit(float(step)))
    rows = rows.withColumn("_brk", F.coalesce((F.col("_gap") > F.lit(float(factor)) * F.col("_step")).cast("int"), F.lit(0)))
    placed = _running_sum(rows, by, "_x", "_brk", "chunk")
    return placed.groupBy(*by, "chunk").agg(F.min("_x").alias("x_start"), F.max("_x").alias("x_end"), F.sum("_n").alias("n"))


def smoothed_weight(half: int, weight: str = "w_rob") -> Column:
    """Mean weight of a cell and ``half`` neighbours on each side, within its object."""
    w = Window.partitionBy("obj_id").orderBy("feat_id").rowsBetween(-half, half)
    return F.avg(weight).over(w)


def low_weight_runs(cells: DataFrame, half: int, threshold: float, weight: str = "w_rob") -> DataFrame:
    """Stretches of adjacent cells whose smoothed weight is below the threshold: (obj_id, run, start, end, n, mean_weight).

    A window holds one object, that is at most one row a feature.
    """
    low = cells.withColumn("_s", smoothed_weight(half, weight)).filter(F.col("_s") < threshold)
    order = Window.partitionBy("obj_id").orderBy("feat_id")
    # adjacent features keep the same difference to their running number
    runs = low.withColumn("_island", F.col("feat_id") - F.row_number().over(order))
    out = runs.groupBy("obj_id", "_island").agg(
        F.min("feat_id").alias("feat_start"), F.max("feat_id").alias("feat_end"), F.count(F.lit(1)).alias("n"), F.avg(weight).alias("mean_weight")
    )
    number = F.row_number().over(Window.partitionBy("obj_id").orderBy("feat_start")) - 1
    return out.withColumn("run", number).drop("_island")


def in_range(lines: DataFrame, low: float, high: float, species: list[str] | None = None) -> DataFrame:
    """Lines inside a range, both ends included, optionally of some species only."""
    kept = lines.filter(F.col("x").between(low, high))
    return kept if species is None else kept.filter(F.col("species").isin(species))


def clip_bands(bands: DataFrame, low: float, high: float) -> DataFrame:
    """Bands that overlap a range."""
    return bands.filter((F.col("x_end") >= low) & (F.col("x_start") <= high))


#: Rows of one side that a tile of a crowded grid cell holds on average.
TILE = 4_096


def _dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deal the rows of crowded cells ``_g`` to tiles (_g, _a, _b), so that each pair of rows of a cell meets in one tile.

    A cell with n and m rows has ceil(n / TILE) x ceil(m / TILE) tiles; a row goes to one line of them. Both sides are written
    first: rows get their tiles by their number in the written table, equal rows too, and a task that runs again deals them alike.
    """
    left, right = (checkpointed(side).withColumn("_id", F.monotonically_increasing_id()) for side in (left, right))
    n = left.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).alias("_na"))
    m = right.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).alias("_nb"))
    # one row for at least TILE rows of a side
    crowded = pin_small(checkpointed(n.join(m, "_g").filter((F.col("_na") > 1) | (F.col("_nb") > 1))))

    def deal(side: DataFrame, own: str, other: str) -> DataFrame:
        counts = {c: F.coalesce(F.col(f"_n{c[1]}"), F.lit(1)) for c in (own, other)}
        drawn = F.pmod(F.xxhash64("_id"), counts[own])
        side = side.join(crowded, "_g", "left").withColumn(own, drawn).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), counts[other] - 1)))
        return side.drop("_id", "_na", "_nb")

    return deal(left, "_a", "_b"), deal(right, "_b", "_a")


def match_ranges(segments: DataFrame, known: DataFrame, grid: float, margin: float = 0.0) -> DataFrame:
    """Known lines (``x``) or bands (``x_start, x_end``) that a segment (``seg_start, seg_end``) touches.

    Segments and known ranges are listed in the grid cells they cover and joined on the cell; each
    match is kept once, in the first cell both cover. The known side is broadcast when proven small; else both
    sides are shuffled, and crowded cells are dealt to tiles of bounded size.
    """
    step = F.lit(float(grid))

    def cells(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / step), F.floor(hi / step)))

    k = known if "x_start" in known.columns else known.withColumns({"x_start": F.col("x"), "x_end": F.col("x")})
    m = F.lit(float(margin))
    k = k.withColumns({"_lo": F.col("x_start") - m, "_hi": F.col("x_end") + m})
    k = k.withColumn("_g", cells(F.col("_lo"), F.col("_hi")))
    s = segments.withColumn("_g", cells(F.col("seg_start"), F.col("seg_end")))
    touch = (F.col("_hi") >= F.col("seg_start")) & (F.col("_lo") <= F.col("seg_end"))
    first = F.col("_g") == F.floor(F.greatest("_lo", "seg_start") / step)
    small, on = pin_small(k), ["_g"]
    if small is k:
        (s, small), on = _dealt(s, k), ["_g", "_a", "_b"]
    return s.join(small, on).filter(touch & first).drop(*on, "_lo", "_hi")


# A near-duplicate search looks at this many pieces of the tolerance, and at blocks of so many tolerances.
PIECES = 64
BLOCK = 64


def dedupe_lines(lines: DataFrame, tol: float, decimals: int = 9) -> DataFrame:
    """Keep a line unless one kept before it lies within ``tol``; lists in order, then places within a list.

    ``lines`` is (list_no, pos, x, ...) with unique (list_no, pos). Decided in rounds: a line that
    comes before all undecided lines in its reach is kept, and rules these out; the result equals
    the one-by-one order. The search sees the first line of each small piece of the axis, found by
    partial aggregation, so however many lines crowd a place, no task gathers them.
    """
    # places in units of the given decimal, so that a line exactly tol away is no duplicate
    unit = 10**decimals
    span = round(float(tol) * unit)
    piece = max(1, span // PIECES)
    # pieces that a line's reach can touch on each side: a little more than the reach, never less
    reach = (span - 1) // piece + 1
    per_block = PIECES * BLOCK
    at = F.round(F.col("x") * F.lit(float(unit))).cast("bigint")
    todo = lines.groupBy(at.alias("at")).agg(F.min(F.struct("list_no", "pos")).alias("rank"))

    def floor_div(c: Column, n: int) -> Column:
        return F.floor((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("bigint")

    near = Window.partitionBy("_b").orderBy("_p").rangeBetween(-reach, reach)
    kept = None
    while True:
        firsts = todo.groupBy(floor_div(F.col("at"), piece).alias("_p")).agg(F.min(F.struct("rank", "at")).alias("_f"))
        home = floor_div(F.col("_p"), per_block)
        blocks = F.array_distinct(F.array(floor_div(F.col("_p") - reach, per_block), home, floor_div(F.col("_p") + reach, per_block)))
        seen = firsts.withColumn("_home", home).withColumn("_b", F.explode(blocks)).withColumn("_least", F.min("_f.rank").over(near))
        chosen = seen.filter((F.col("_b") == F.col("_home")) & (F.col("_f.rank") == F.col("_least")))
        chosen = checkpointed(chosen.select("_f.rank", "_f.at"))
        kept = chosen if kept is None else kept.unionByName(chosen)
        # kept lines are at least tol apart: a line meets a few of them at most
        spread = chosen.select(F.col("at").alias("_k"), F.explode(F.array(*[floor_div(F.col("at"), span) + i for i in (-1, 0, 1)])).alias("_c"))
        open_ = todo.withColumn("_c", floor_div(F.col("at"), span)).alias("l")
        k = pin_small(spread).alias("k")
        ruled = (F.col("l._c") == F.col("k._c")) & (F.abs(F.col("l.at") - F.col("k._k")) < span)
        todo = checkpointed(open_.join(k, ruled, "left_anti").select("at", "rank"))
        if todo.isEmpty():
            break
    return lines.join(kept.select("rank.list_no", "rank.pos"), ["list_no", "pos"], "left_semi")
