"""Near-duplicates among vectors: epsilon grid order join.

Unit vectors are within ``eps`` of each other exactly where their cosine reaches the threshold. They are turned to their
principal dimensions and sorted by the cells, ``eps`` wide, in which the leading ones lie: the epsilon grid order. The sequence is cut into
blocks, blocks into longer intervals, up to one that holds all. From that one, pairs of intervals are
taken apart into pairs of their parts; a pair whose bounding boxes are further apart than ``eps`` goes, with all in it.
Boxes have one more side, the length outside the leading dimensions, which bounds the distance too.

Pairs of blocks that stay are compared in stripes of the sequence: a task holds the blocks of one stripe, and the
blocks they are paired with stream by. A product in the leading dimensions leaves few rows to compare in full. Out come the number of
links of each vector and, of the links between two blocks, a forest that connects the same vectors.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import batched, components, stored, table
from plumbline.llm.vectors import matrix

COSINE = 0.95
#: Leading principal dimensions.
DIMS = 16
#: Vectors of a block, and parts of an interval.
BLOCK, FAN = 512, 8
#: Vectors that the principal dimensions are fitted on, and their bytes at most.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Bytes of the vectors (as doubles) that a task holds, and stripes it compares them with.
STRIPE_BYTES, STRIPES = 48 << 20, 16
#: With more candidates between two blocks than this, all their products are taken at once.
MANY = 4_000
#: Rounding errors of distances are far below this.
SLACK = 1e-9


def _valid(v: Column) -> Column:
    """A vector with a direction: no null or non-finite component, and one at least that is not 0."""
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _classes(rows: DataFrame) -> DataFrame:
    """cls, v, copies, first: one row for each distinct vector, with the number of its rows and their smallest id."""
    grouped = rows.groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    return stored(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(classes: DataFrame, dims: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and leading principal directions for each length of vectors that is in a bounded sample drawn by hash."""
    n, widest = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return {}
    share = min(1.0, SAMPLE / n, SAMPLE_BYTES / (8 * widest * n))
    draw = F.pmod(F.xxhash64("cls", F.lit("axes")), F.lit(1 << 30))
    drawn = classes.where(draw < int(share * (1 << 30)) + 1).select("v").toArrow().column(0).combine_chunks()
    length = drawn.value_lengths().to_numpy()
    out = {}
    for width in np.unique(length).tolist():
        u = unit(matrix(drawn.filter(pa.array(length == width))))
        mean = u.mean(axis=0)
        _, vectors = np.linalg.eigh((u - mean).T @ (u - mean))
        out[width] = mean, np.ascontiguousarray(vectors[:, ::-1][:, :dims])
    return out


def _place(u: np.ndarray, axes: dict, dims: int) -> np.ndarray:
    """Leading coordinates and the length outside them. Vectors of a length that was not drawn keep their own axes."""
    mean, turn = axes.get(u.shape[1]) or (0.0, np.eye(u.shape[1], min(dims, u.shape[1])))
    shifted = u - mean
    out = np.zeros((len(u), dims + 1))
    lead = shifted @ turn
    out[:, : lead.shape[1]] = lead
    out[:, dims] = np.sqrt(np.maximum((shifted * shifted).sum(axis=1) - (lead * lead).sum(axis=1), 0))
    return out


_ORDER = pa.schema([("width", pa.int32()), ("cells", pa.list_(pa.int32())), ("cls", pa.int64()), ("copies", pa.int64()), ("box", pa.list_(pa.float64())), ("v", pa.binary())])
_ORDER_DDL = "width int, cells array<int>, cls long, copies long, box array<double>, v binary"


def _ordered(classes: DataFrame, axes: dict, eps: float, dims: int, single: bool) -> DataFrame:
    kind = "<f4" if single else "<f8"

    def run(batches):
        for b in batches:
            length = b.column(2).value_lengths().to_numpy()
            for width in np.unique(length).tolist():
                mine = b.filter(pa.array(length == width))
                x = matrix(mine.column(2))
                place = _place(unit(x), axes, dims)
                cells = np.floor(place[:, :dims] / eps).astype(np.int32)
                lists = [pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), a.ravel()) for a in (cells, place)]
                own = [r.tobytes() for r in x.astype(kind)]
                yield pa.RecordBatch.from_arrays([pa.array([width] * len(x), pa.int32()), lists[0], mine.column(0), mine.column(1), lists[1], pa.array(own, pa.binary())], schema=_ORDER)

    return batched(classes.select("cls", "copies", "v"), run, _ORDER_DDL)


_BLOCK = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("width", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("cls", pa.binary()), ("copies", pa.binary()), ("v", pa.binary())])
_BLOCK_DDL = "part int, nth long, width int, low array<double>, high array<double>, cls binary, copies binary, v binary"


def _cut(block: int):
    def run(batches):
        from pyspark import TaskContext

        part, nth, held = TaskContext.get().partitionId(), 0, []

        def closed():
            nonlocal nth, held
            rows = pa.Table.from_batches(held)
            box = matrix(rows.column("box").combine_chunks())
            row = (part, nth, rows.column("width")[0].as_py(), box.min(axis=0).tolist(), box.max(axis=0).tolist(),
                   rows.column("cls").to_numpy().astype("<i8").tobytes(), rows.column("copies").to_numpy().astype("<i8").tobytes(), b"".join(rows.column("v").to_pylist()))
            nth, held = nth + 1, []
            return pa.RecordBatch.from_pydict({k: [x] for k, x in zip(_BLOCK.names, row)}, schema=_BLOCK)

        for b in batches:
            lo, width = 0, b.column("width").to_numpy()
            while lo < b.num_rows:
                room = block - sum(h.num_rows for h in held)
                if held and held[0].column("width")[0].as_py() != width[lo]:
                    yield closed()
                    continue
                same = int(np.searchsorted(width[lo:], width[lo], "right"))
                held.append(b.slice(lo, min(room, same)))
                lo += min(room, same)
                if min(room, same) == room:
                    yield closed()
        if held:
            yield closed()

    return run


def _blocks(ordered: DataFrame, block: int) -> DataFrame:
    """Blocks of the sequence, numbered without gaps. The driver gets one row a partition."""
    keys = ["width", "cells", "cls"]
    cut = stored(batched(ordered.repartitionByRange(*keys).sortWithinPartitions(*keys), _cut(block), _BLOCK_DDL), "blocks")
    counts = sorted(tuple(r) for r in cut.groupBy("part").count().collect())
    first = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    parts = cut.sparkSession.createDataFrame([(p, f) for (p, _), f in zip(counts, first)], "part int, first long")
    return cut.join(F.broadcast(parts), "part").select((F.col("first") + F.col("nth")).alias("no"), "width", "low", "high", "cls", "copies", "v")


def _block_pairs(blocks: DataFrame, eps: float, dims: int) -> DataFrame:
    """(a, b), a <= b: all pairs of blocks that may hold links, found from the whole sequence down."""
    sides = range(dims + 1)
    flat = [F.col("low")[j].alias(f"l{j}") for j in sides] + [F.col("high")[j].alias(f"h{j}") for j in sides]
    # blocks of other lengths of vectors never match: the length is one more side
    wide = F.col("width").cast("double")
    levels = [stored(blocks.select("no", *flat, wide.alias(f"l{dims + 1}"), wide.alias(f"h{dims + 1}")), "boxes")]
    sides = range(dims + 2)
    n = levels[0].count()
    while n > 1:
        up = levels[-1].groupBy(F.floor(F.col("no") / FAN).alias("no")).agg(*[F.min(f"l{j}").alias(f"l{j}") for j in sides], *[F.max(f"h{j}").alias(f"h{j}") for j in sides])
        levels.append(stored(up, "boxes"))
        n = -(-n // FAN)
    pairs = levels[-1].select(F.col("no").alias("a"), F.col("no").alias("b"))
    for boxes in levels[-2::-1]:
        part = F.floor(F.col("no") / FAN)
        one = boxes.select(part.alias("a"), F.col("no").alias("x"), *[F.col(f"{e}{j}").alias(f"a{e}{j}") for e in "lh" for j in sides])
        two = boxes.select(part.alias("b"), F.col("no").alias("y"), *[F.col(f"{e}{j}").alias(f"b{e}{j}") for e in "lh" for j in sides])
        gaps = [F.greatest(F.lit(0.0), F.col(f"al{j}") - F.col(f"bh{j}"), F.col(f"bl{j}") - F.col(f"ah{j}")) for j in sides]
        near = reduce(lambda s, g: s + g * g, gaps[1:], gaps[0] * gaps[0]) <= eps * eps + SLACK
        pairs = stored(pairs.join(one, "a").join(two, "b").where((F.col("x") <= F.col("y")) & near).select(F.col("x").alias("a"), F.col("y").alias("b")), "pairs")
    return pairs


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that connect what the links (i, j) among nodes 0 to n - 1 connect."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


class _Rows:
    """A block in a task."""

    def __init__(self, width: int, cls: bytes, copies: bytes, v: bytes, axes: dict, dims: int):
        self.cls, self.copies = np.frombuffer(cls, "<i8"), np.frombuffer(copies, "<i8")
        kind = "<f4" if len(v) == 4 * width * len(self.cls) else "<f8"
        self.unit = unit(np.frombuffer(v, kind).reshape(-1, width).astype(np.float64))
        self.place = _place(self.unit, axes, dims)
        self.norm = (self.place * self.place).sum(axis=1)
        self.links = np.zeros(len(self.cls), np.int64)


def compare(a: _Rows, b: _Rows, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of two blocks whose cosine reaches the threshold; with one block twice, i < j."""
    gap = a.norm[:, None] + b.norm[None, :] - 2 * (a.place @ b.place.T)
    i, j = np.nonzero(gap <= eps * eps + SLACK)
    if a is b:
        i, j = i[i < j], j[i < j]
    if len(i) > MANY:
        fine = (a.unit @ b.unit.T)[i, j] >= cosine
    else:
        fine = np.einsum("ij,ij->i", a.unit[i], b.unit[j]) >= cosine
    return i[fine], j[fine]


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _compare(cosine: float, eps: float, axes: dict, dims: int):
    """Blocks come by stripe, its own ones first. Out: (vector, null, links) and (vector, vector, null)."""

    def links(rows: _Rows):
        some = np.flatnonzero(rows.links)
        return pa.RecordBatch.from_arrays([pa.array(rows.cls[some]), pa.nulls(len(some), pa.int64()), pa.array(rows.links[some])], schema=_FOUND)

    def run(batches):
        now, own = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if (r["stripe"], r["chunk"]) != now:
                    yield from (links(x) for x in own.values())
                    now, own = (r["stripe"], r["chunk"]), {}
                if r["partners"] is None:
                    own[r["no"]] = _Rows(r["width"], r["cls"], r["copies"], r["v"], axes, dims)
                    continue
                b, edges = None, []
                for no in sorted(r["partners"]):
                    a = own[no]
                    if no == r["no"]:
                        other = a
                    else:
                        other = b = b or _Rows(r["width"], r["cls"], r["copies"], r["v"], axes, dims)
                    i, j = compare(a, other, cosine, eps)
                    if not len(i):
                        continue
                    np.add.at(a.links, i, other.copies[j])
                    np.add.at(other.links, j, a.copies[i])
                    shift = 0 if a is other else len(a.cls)
                    ids = a.cls if a is other else np.concatenate([a.cls, other.cls])
                    node, root = forest(i, j + shift, len(ids))
                    edges.append((ids[node], ids[root]))
                if b is not None:
                    yield links(b)
                if edges:
                    one, two = (np.concatenate(x) for x in zip(*edges))
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.nulls(len(one), pa.int64())], schema=_FOUND)
        yield from (links(x) for x in own.values())

    return run


def _found(blocks: DataFrame, pairs: DataFrame, stripe: int, run) -> DataFrame:
    """Every pair of blocks goes to the stripe of one of them, to each about as often."""
    of_a, of_b = F.floor(F.col("a") / stripe), F.floor(F.col("b") / stripe)
    first = (of_a + of_b) % 2 == 0
    at = pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("own"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("no"))
    at = at.select("own", "no", F.floor(F.col("own") / stripe).alias("stripe"), F.floor(F.col("no") / (stripe * STRIPES)).alias("chunk"))
    held = at.select("stripe", "chunk", F.col("own").alias("no")).distinct().withColumn("partners", F.lit(None).cast("array<long>"))
    asked = at.groupBy("stripe", "chunk", "no").agg(F.collect_list("own").alias("partners"))
    asks = stored(held.unionByName(asked), "asks")
    tasks = asks.select("stripe", "chunk").distinct().count()
    payload = blocks.select("no", "width", "cls", "copies", "v")
    rows = asks.join(payload, "no").withColumn("late", F.col("partners").isNotNull())
    rows = rows.repartition(max(1, 2 * tasks), "stripe", "chunk").sortWithinPartitions("stripe", "chunk", "late", "no")
    return stored(batched(rows, run, "a long, b long, n long"), "found")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, dims: int = DIMS, block: int = BLOCK, stripe: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors of different lengths have no cosine and don't link. Equal vectors are compared once, and each counts the others as links.
    Nulls: a vector that is null, zero or holds a null or a non-finite component links with nothing; a null id comes after
    all others and names a component only where it has no other. Repeated rows are vectors of their own and link. An empty table gives
    no rows. Other columns are not read. ``stripe`` is the number of blocks a task holds, by default a share of the table within bounds.
    """
    single = dict(rows.dtypes)[vector_col] == "array<float>"
    kind = "array<float>" if single else "array<double>"
    rows = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].cast(kind).alias("v"))
    fine, rest = rows.where(_valid(F.col("v"))), rows.where(~F.coalesce(_valid(F.col("v")), F.lit(False)))
    classes = _classes(fine)
    eps = float(np.sqrt(2 - 2 * cosine))
    axes = _axes(classes, dims)
    n, widest = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    block = max(8, min(block, (8 << 20) // (8 * (widest or 1))))
    if stripe is None:
        most = max(1, STRIPE_BYTES // (8 * (widest or 1) * block))
        stripe = max(1, min(most, n // (block * 2 * rows.sparkSession.sparkContext.defaultParallelism)))
    blocks = _blocks(_ordered(classes, axes, eps, dims, single), block)
    found = _found(blocks, _block_pairs(blocks, eps, dims), stripe, _compare(cosine, eps, axes, dims))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    known = classes.select("cls", "copies", "first").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "copies", "first", F.coalesce("root", "cls").alias("root"))
    known = stored(known.join(links, "cls", "left").select("cls", "first", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    told = stored(known.join(least, "root").select("cls", "n_links", "component_id"), "told")
    named = stored(classes.select("cls", "v").join(told, "cls").select("v", "n_links", "component_id"), "named")
    linked = fine.join(named, "v").select("id", "n_links", "component_id")
    alone = rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_egojoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs, in blocks of no kind.
SQL = f"""
WITH RECURSIVE fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), links AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN links ON links.a = vec_id
"""
