"""One pass over the objects: a narrow Arrow map whose small per-task matrices are summed by Spark.

The map of a pass emits two kinds of rows through one schema. ``state`` rows carry what has to be
remembered per object; ``sum`` rows carry a task's contribution to a few driver-sized matrices.
Both are written to a scratch table in the shared folder, so the map runs once whatever reads
them, the lineage stays short, and a lost executor costs a task and not the fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from plumbline.functions import kernels
from plumbline.runtime import Scratch, arrow_map

KEYS = ["grp", "obj_id"]
# Matrices travel as rows of at most this many numbers, summed as that many scalar columns.
CHUNK = 64
ROW_SCHEMA = "kind string, grp int, obj_id bigint, mat int, r int, chunk int, vec array<double>"
# Sum matrices of one pass that the driver accepts in total.
DRIVER_BYTES = 512 << 20
# Sum rows of all tasks of a pass that one task adds up and solves; more are shuffled by feature.
GATHER_BYTES = 8 << 20
# Objects of a bucket that the executors hold, joined with their state, for passes that only make sums; and of a task there,
# where more buckets than cores have less than that.
HOLD_BYTES = 64 << 20
HOLD_TASK_BYTES = 4 << 20
# Cells handled by one step of the kernels: a few matrices of this size stay in a core's cache.
BLOCK_CELLS = 128_000


@dataclass
class Sums:
    """Matrices summed over all rows a task sees, addressed by a number from 0, and maxima likewise."""

    mats: dict[int, np.ndarray] = field(default_factory=dict)
    tops: dict[int, float] = field(default_factory=dict)

    def add(self, mat: int, value: np.ndarray) -> None:
        value = np.atleast_2d(value)
        if mat in self.mats:
            self.mats[mat] += value
        else:
            self.mats[mat] = value.copy()

    def top(self, mat: int, value: float) -> None:
        self.tops[mat] = max(value, self.tops.get(mat, -np.inf))


def state_rows(grp: pa.Array, obj: pa.Array, vec: np.ndarray) -> pa.RecordBatch:
    n = len(grp)
    none = pa.nulls(n, pa.int32())
    kind = pa.array(["state"] * n, pa.string())
    return pa.RecordBatch.from_arrays([kind, grp, obj, none, none, none, kernels.lists(vec)], names=_NAMES)


_NAMES = [part.split()[0] for part in ROW_SCHEMA.split(", ")]


def sum_rows(mat: int, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows, width = value.shape
    for c in range(0, width, CHUNK):
        part = value[:, c : c + CHUNK]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["sum"] * rows, pa.string()),
                pa.array(np.full(rows, -1, np.int32)),
                pa.array(np.zeros(rows, np.int64)),
                pa.array(np.full(rows, mat, np.int32)),
                pa.array(np.arange(rows, dtype=np.int32)),
                pa.array(np.full(rows, c // CHUNK, np.int32)),
                kernels.lists(part),
            ],
            names=_NAMES,
        )


def blocks(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK_CELLS // max(1, width))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _steps(batches: Iterator[pa.RecordBatch], step, width: int, sums: Sums) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None]]:
    for batch in batches:
        for block in blocks(batch, width):
            if block.num_rows == 0:
                continue
            if not np.all(np.diff(block.column("y").offsets.to_numpy()) == width):
                raise ValueError(f"all objects must have {width} features")
            yield block, step(block, sums)


def mapper(step: Callable[[pa.RecordBatch, Sums], np.ndarray | None], width: int):
    """Turn a kernel ``step(batch, sums) -> state vectors`` into a function for ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for block, vec in _steps(batches, step, width, sums):
            if vec is not None:
                yield state_rows(block.column("grp"), block.column("obj_id"), vec)
        for mat, value in sums.mats.items():
            yield from sum_rows(mat, value)
        for mat, value in sums.tops.items():
            yield from sum_rows(-1 - mat, np.array([[value]]))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one value, its Arrow stream."""
    for batch in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["rows"])


def summer(step: Callable[[pa.RecordBatch, Sums], np.ndarray | None], width: int):
    """Turn a kernel into a function from the packed batches of a task to its sums and maxima."""

    def run(packed: Iterator) -> Iterator[tuple[dict[int, np.ndarray], dict[int, float]]]:
        sums = Sums()
        for _ in _steps((b for p in packed for b in pa.ipc.open_stream(p["rows"])), step, width, sums):
            pass
        yield sums.mats, sums.tops

    return run


def few(shapes: dict[int, tuple[int, int]], tasks: int | None) -> bool:
    """Whether the sums of so many tasks are few enough to meet in one place."""
    return tasks is not None and tasks * sum(8 * r * c for r, c in shapes.values()) <= GATHER_BYTES


def _solver(ranks: dict[int, int], ridge: float | None):
    """Add up the normal sums of the features that come by, in order of matrix and feature, and solve each feature's system."""

    def added(r: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        return r[first], np.add.reduceat(v, first, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list]] = {}
        for b in batches:
            mats, rs, chunks = (b.column(c).to_numpy() for c in ("mat", "r", "chunk"))
            for mat in np.unique(mats).tolist():
                for chunk in np.unique(chunks[mats == mat]).tolist():
                    own = np.flatnonzero((mats == mat) & (chunks == chunk))
                    part = added(rs[own], kernels.matrix(b.column("vec").take(pa.array(own))))
                    held.setdefault(mat, {}).setdefault(chunk, []).append(part)
        for mat, by_chunk in held.items():
            sums = []
            for chunk in sorted(by_chunk):
                # a feature at the end of one batch may go on in the next
                r, v = added(*(np.concatenate(x) for x in zip(*by_chunk[chunk])))
                sums.append(v)
            full, k = np.hstack(sums), ranks[mat]
            p = k * (k + 1) // 2
            g = kernels.solve_packed(full[:, :p], full[:, p:], ridge)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), mat, np.int32)), pa.array(r), kernels.lists(g)], names=["mat", "r", "vec"])

    return run


def _gathered(ranks: dict[int, int], ridge: float | None):
    """All sum rows added up, and the systems of normal sums solved, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        tops: dict[int, float] = {}
        for b in batches:
            mats, rs, chunks = (b.column(c).to_numpy() for c in ("mat", "r", "chunk"))
            for mat, chunk in np.unique(np.stack([mats, chunks]), axis=1).T.tolist():
                own = np.flatnonzero((mats == mat) & (chunks == chunk))
                v = kernels.matrix(b.column("vec").take(pa.array(own)))
                if mat < 0:
                    tops[mat] = np.maximum(tops.get(mat, -np.inf), v.max())
                    continue
                held.setdefault((mat, chunk), []).append((rs[own], v))
        added: dict[int, list] = {}
        for mat, chunk in sorted(held):
            r, v = (np.concatenate(x) for x in zip(*held.pop((mat, chunk))))
            r, at = np.unique(r, return_inverse=True)
            total = np.zeros((len(r), v.shape[1]))
            np.add.at(total, at, v)
            added.setdefault(mat, []).append((chunk, r, total))
        for mat, parts in added.items():
            if mat in ranks:
                p = ranks[mat] * (ranks[mat] + 1) // 2
                full = np.hstack([total for _, _, total in parts])
                parts = [(-1, parts[0][1], kernels.solve_packed(full[:, :p], full[:, p:], ridge))]
            for chunk, r, v in parts:
                yield _added_rows(mat, r, chunk, v, None)
        for mat, top in tops.items():
            yield _added_rows(mat, np.zeros(1), 0, np.array([[top]]), float(top))

    return run


def _added_rows(mat: int, r: np.ndarray, chunk: int, v: np.ndarray, top: float | None) -> pa.RecordBatch:
    n = len(r)
    whole = [pa.array(x, pa.int32()) for x in (np.full(n, mat, np.int32), r.astype(np.int32), np.full(n, chunk, np.int32))]
    return pa.RecordBatch.from_arrays([*whole, kernels.lists(v), pa.array([top] * n, pa.float64())], names=["mat", "r", "chunk", "vec", "top"])


def _spread(rows: DataFrame, sizes: dict[int, tuple[int, int]], ranks: dict[int, int], ridge: float | None) -> DataFrame:
    """The same by partial sums and shuffles."""
    width = min(CHUNK, max((c for _, c in sizes.values()), default=1))
    small = rows if not ranks else rows.filter(~F.col("mat").isin(list(ranks)))
    added = small.groupBy("mat", "r", "chunk").agg(
        *[F.sum(F.get("vec", F.lit(i))).alias(f"v{i}") for i in range(width)], F.max(F.get("vec", F.lit(0))).alias("top")
    )
    added = added.select("mat", "r", "chunk", F.array(*[f"v{i}" for i in range(width)]).alias("vec"), "top")
    if ranks:
        # a task's sums are added up already: one shuffle brings those of a feature together
        normal = rows.filter(F.col("mat").isin(list(ranks))).select("mat", "r", "chunk", "vec").repartition("mat", "r").sortWithinPartitions("mat", "r", "chunk")
        solved = arrow_map(normal, _solver(ranks, ridge), "mat int, r int, vec array<double>")
        added = added.unionByName(solved.select("mat", "r", F.lit(-1).alias("chunk"), "vec", F.lit(None).cast("double").alias("top")))
    return added


def collect_sums(
    rows: DataFrame, shapes: dict[int, tuple[int, int]], ranks: dict[int, int] | None = None, ridge: float | None = None,
    tasks: int | None = None, written: bool = True,
) -> dict[int, np.ndarray]:
    """Add up the ``sum`` rows of all tasks: partial sums, one small shuffle, then the driver.

    The maximum numbered n comes back under ``-1 - n``. Normal sums, of the matrices in ``ranks``, are added up and solved
    where they were shuffled to: the driver gets the basis in their place, K numbers a feature. If the rows of so many
    ``tasks`` are few, one task adds and solves them all: a cycle of a small fit is nearly all cost of jobs and shuffles.
    ``written`` rows are gathered without a shuffle.
    """
    ranks = ranks or {}
    sizes = {m: s for m, s in shapes.items() if m not in ranks}
    total = sum(r * c * 8 for r, c in sizes.values())
    if total > DRIVER_BYTES:
        raise ValueError(f"the sums of one pass need {total >> 20} MB on the driver; fit fewer models or features at a time")
    if few(shapes, tasks):
        made = rows.select("mat", "r", "chunk", "vec")
        added = arrow_map(made.coalesce(1) if written else made.repartition(1), _gathered(ranks, ridge), "mat int, r int, chunk int, vec array<double>, top double")
    else:
        added = _spread(rows, sizes, ranks, ridge)
    table = added.toArrow().combine_chunks()
    out = {m: np.zeros(s if m not in ranks else (s[0], ranks[m])) for m, s in shapes.items() if m >= 0}
    mats, rs, cs = (table.column(c).to_numpy() for c in ("mat", "r", "chunk"))
    vec = table.column("vec")
    for m in out:
        pick = mats == m
        for c in np.unique(cs[pick]):
            at = np.flatnonzero(pick & (cs == c))
            values = kernels.matrix(vec.take(pa.array(at)).combine_chunks(), float)
            lo = max(0, c) * CHUNK
            cols = out[m].shape[1] if c < 0 else min(CHUNK, out[m].shape[1] - lo)
            out[m][rs[at], lo : lo + cols] = values[:, :cols]
    tops = table.column("top").to_numpy()
    out.update({m: tops[[i]] for i, m in enumerate(mats) if m < 0})
    return out


class Passes:
    """The training rows, laid out once by (grp, obj_id), and the state table of the latest pass.

    ``ready`` rows are bucketed by the keys already and are read where they are.
    """

    def __init__(self, objects: DataFrame, columns: list[str], buckets: int | None = None, ready: bool = False):
        self.spark = objects.sparkSession
        self.scratch = Scratch(self.spark, buckets)
        self.objects = objects.select(*KEYS, *columns)
        if not ready:
            self.objects = self.scratch.put_spread(self.objects, "objects", KEYS)
        self.columns = columns
        self.width, self.n_objects = self._size()
        self.state: DataFrame | None = None
        self._held: RDD | None = None
        self.n = 0
        self._live: list[str] = []

    def _size(self) -> tuple[int, int]:
        # the first row gives the width, which every pass then checks; counting reads no arrays
        first = self.objects.select(F.size(self.columns[0]).alias("m")).first()
        if first is None:
            raise ValueError("there are no objects")
        return first["m"], self.objects.count()

    def rows(self, state: DataFrame | None = None) -> DataFrame:
        """Objects with their state. Both tables are bucketed alike: the join shuffles and sorts nothing."""
        state = self.state if state is None else state
        if state is None:
            return self.objects
        return self.objects.join(state.hint("shuffle_hash"), KEYS)

    def _bytes(self) -> int:
        return 8 * self.n_objects * self.width * len(self.columns)

    def tasks(self) -> int:
        """Tasks of a pass over the rows that the executors hold: small buckets go together, down to one task a core."""
        return min(self.scratch.buckets, max(self.spark.sparkContext.defaultParallelism, self._bytes() // HOLD_TASK_BYTES))

    def holds(self, shapes: dict[int, tuple[int, int]]) -> bool:
        """Whether objects and sums are small enough for a pass over the rows that the executors hold."""
        return self._bytes() <= HOLD_BYTES * self.scratch.buckets and few(shapes, self.tasks())

    def sum_up(self, step, shapes: dict[int, tuple[int, int]], ranks: dict[int, int] | None = None, ridge: float | None = None) -> dict[int, np.ndarray]:
        """One pass that writes nothing, over rows that are joined once a state and held by the executors; what an executor
        loses is read again from the tables. The few sums of the tasks are added up and solved by the driver, so that such a
        pass is one job of one stage.
        """
        if self._held is None:
            packed = arrow_map(self.rows(), _packed, "rows binary").rdd
            self._held = packed.coalesce(self.tasks()).persist(StorageLevel.MEMORY_AND_DISK)
        total = Sums()
        for mats, tops in self._held.mapPartitions(summer(step, self.width)).collect():
            for mat, value in mats.items():
                total.add(mat, value)
            for mat, value in tops.items():
                total.tops[mat] = np.maximum(value, total.tops.get(mat, -np.inf))
        out = {m: np.zeros(s) for m, s in shapes.items()} | total.mats
        for mat, k in (ranks or {}).items():
            p = k * (k + 1) // 2
            out[mat] = kernels.solve_packed(out[mat][:, :p], out[mat][:, p:], ridge)
        return out | {-1 - mat: np.array([top]) for mat, top in total.tops.items()}

    def let_go(self) -> None:
        """Free the rows that are held."""
        if self._held is not None:
            self._held.unpersist()
            self._held = None

    def run(
        self, step, shapes: dict[int, tuple[int, int]], rows: DataFrame | None = None, keep: bool = True,
        ranks: dict[int, int] | None = None, ridge: float | None = None,
    ) -> dict[int, np.ndarray]:
        """One pass: map, write, sum. With ``keep`` the emitted vectors become the new state. The normal sums of matrices in
        ``ranks`` come back solved."""
        mapped = arrow_map(self.rows() if rows is None else rows, mapper(step, self.width), ROW_SCHEMA)
        if not keep:
            return collect_sums(mapped.filter("kind = 'sum'"), shapes, ranks, ridge, self.scratch.buckets, written=False)
        self.let_go()
        name = f"pass_{self.n}"
        self.n += 1
        written = self.scratch.put(mapped, name, KEYS, partition_by="kind")
        sums = collect_sums(written.filter("kind = 'sum'"), shapes, ranks, ridge, self.scratch.buckets)
        self.state = written.filter("kind = 'state'").select(*KEYS, F.col("vec").alias("state"))
        self._live.append(name)
        return sums

    def forget_before(self, keep: int = 2) -> None:
        """Drop the tables of older passes, all but the last ``keep``."""
        while len(self._live) > keep:
            self.scratch.drop(self._live.pop(0))
