"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the inner product. Every row gets one component more, sqrt(M^2 - |v|^2) with M the largest length, and a query a zero: then the
Euclidean distance of the two falls as their product grows, whatever the lengths.

A tree halves that space again and again by a random unit direction (between two sampled vectors) at the median of
its sample; the forest is fitted on at most ``SAMPLE`` vectors and every row is then put into one leaf of
every tree. A query goes down all trees at once with one priority queue: nodes wait in it by how far
the query lies on their other side, a lower bound of the distance of what is there, and leaves are opened in that order.

How many a query opens follows from the data. Its k-th distance among the sampled vectors is never below the true one. Where that
distance times ``reach`` ends, its queue ends: ``reach`` is learned on the sample as the share of the k-th distance within which
``RECALL`` of the true neighbours have a leaf in some tree. Vectors with structure open few leaves; vectors spread evenly over many dimensions open many, as
nothing else finds their neighbours.

Neighbouring leaves of a tree make a part of bounded size. A query goes to a part once, with the leaves it opens there, and
a task keeps the best of each query over all its parts; these meet in Spark, and the best candidates
are scored exactly on the original vectors.

Equal vectors are one entry, so that no leaf fills with copies.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import batched, stored, table
from plumbline.llm.vectors import best, classes, entries_for, matrix, valid

K = 20
TREES = 6
#: Distinct vectors that directions, medians and the reach are taken from (drawn by a hash; all, if fewer).
SAMPLE = 20_000
#: Sampled vectors of a leaf, at most.
LEAF = 25
#: Share of the true neighbours that the reach is learned for, and sampled vectors that ask for theirs.
RECALL = 0.95
ASKED = 512
#: Vectors that are multiplied together. A part is as many leaves as fit, or a block of one larger leaf.
PART_BYTES = 8 << 20
#: Queries whose best a task holds.
HELD = 20_000
SEED = 5


@dataclass
class Tree:
    """Inner node i goes left at vector @ normals[i] <= cuts[i]; a child c >= 0 is a node, else leaf -c - 1. A node comes before
    its children; leaves are numbered from left to right."""

    normals: np.ndarray
    cuts: np.ndarray
    left: list[int]
    right: list[int]
    leaves: int

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vectors), np.int64) if len(self.left) else np.full(len(vectors), -1)
        left, right = np.array(self.left), np.array(self.right)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = np.einsum("ij,ij->i", vectors[inner], self.normals[node]) <= self.cuts[node]
            at[inner] = np.where(side, left[node], right[node])
        return -at - 1

    def far(self, queries: np.ndarray) -> np.ndarray:
        """How far each query (row) lies on the other side of what leads to each leaf."""
        out = np.zeros((self.leaves, len(queries)))
        margins = self.normals @ queries.T - self.cuts[:, None]
        node_far = np.zeros_like(margins)
        for i, (low, high) in enumerate(zip(self.left, self.right)):
            m, here = margins[i], node_far[i]
            for child, beyond in ((low, m), (high, -m)):
                far = np.maximum(here, beyond)
                if child >= 0:
                    node_far[child] = far
                else:
                    out[-child - 1] = far
        return out.T


def grow(sample: np.ndarray, rng: np.random.Generator) -> Tree:
    """Halve parts until all are small. Vectors that no direction divides stay together."""
    normals, cuts, left, right = [], [], [], []
    leaves = 0
    waiting = [(np.arange(len(sample)), None)]
    while waiting:
        rows, parent = waiting.pop()
        child = None
        if len(rows) > LEAF:
            a, b = sample[rng.choice(rows, 2, replace=False)]
            length = np.linalg.norm(a - b)
            normal = (a - b) / length if length > 0 else a - b
            along = sample[rows] @ normal
            cut = np.median(along)
            low = along <= cut
            if low.all():  # ties at the upper half
                low = along < cut
            if low.any() and not low.all():
                child = len(cuts)
                # half way between the two sides, so that rounding puts no sampled vector on the wrong one
                normals.append(normal), cuts.append((along[low].max() + along[~low].min()) / 2), left.append(0), right.append(0)
                waiting.append((rows[~low], (right, child)))
                waiting.append((rows[low], (left, child)))
        if child is None:
            child = -leaves - 1
            leaves += 1
        if parent is not None:
            parent[0][parent[1]] = child
    return Tree(np.array(normals).reshape(len(cuts), sample.shape[1]), np.array(cuts), left, right, leaves)


def lifted(vectors: np.ndarray, longest2: float) -> np.ndarray:
    """Rows with the component more that makes them equally long."""
    rest = np.sqrt(np.maximum(0.0, longest2 - np.einsum("ij,ij->i", vectors, vectors)))
    return np.hstack([vectors, rest[:, None]])


def asking(vectors: np.ndarray) -> np.ndarray:
    return np.hstack([vectors, np.zeros((len(vectors), 1))])


@dataclass
class Forest:
    """The trees, and what tells how far a query has to look: sampled vectors, the largest squared length, the reach."""

    trees: list[Tree]
    sample: np.ndarray
    longest2: float
    nth: int
    reach: float = 0.0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``nth`` nearest sampled vectors, and the distance of the last of them; endless, if there are fewer."""
        if len(self.sample) < self.nth:
            return np.tile(np.arange(len(self.sample)), (len(vectors), 1)), np.full(len(vectors), np.inf)
        scores = vectors @ self.sample.T
        top = np.argpartition(-scores, self.nth - 1, axis=1)[:, : self.nth]
        least = np.take_along_axis(scores, top, axis=1).min(axis=1)
        return top, np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", vectors, vectors) + self.longest2 - 2.0 * least))

    def learn(self, recall: float, asked: np.ndarray) -> None:
        """Set the reach by the neighbours that sampled vectors have among the others."""
        vectors = self.sample[asked]
        top, distance = self.nearest(vectors)
        if not np.isfinite(distance).all():
            self.reach = 1.0
            return
        queries, places = asking(vectors), lifted(self.sample, self.longest2)
        far = np.full(top.shape, np.inf)
        for tree in self.trees:
            leaf = tree.leaf_of(places)
            far = np.minimum(far, np.take_along_axis(tree.far(queries), leaf[top], axis=1))
        share = np.divide(far, distance[:, None], out=np.zeros_like(far), where=distance[:, None] > 0)
        self.reach = float(np.quantile(share[top != asked[:, None]], recall)) if top.shape[1] > 1 else 1.0

    def limits(self, vectors: np.ndarray) -> np.ndarray:
        return self.reach * self.nearest(vectors)[1]


def open_leaves(trees: list[Tree], query: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one priority queue over all trees, up to a distance; each tree's own leaf at least."""
    margins = [(t.normals @ query - t.cuts).tolist() for t in trees]
    waiting = [(0.0, i, 0 if t.left else -1) for i, t in enumerate(trees)]
    heapq.heapify(waiting)
    found = []
    while waiting:
        far, i, node = heapq.heappop(waiting)
        tree, margin = trees[i], margins[i]
        while node >= 0:
            m = margin[node]
            near, other = (tree.left[node], tree.right[node]) if m <= 0 else (tree.right[node], tree.left[node])
            beyond = max(far, abs(m))
            if beyond <= limit:
                heapq.heappush(waiting, (beyond, i, other))
            node = near
        found.append((i, -node - 1))
    return found


_NAMES = ["tree", "part", "block", "query", "leaf", "id", "v", "leaves"]
_DDL = "tree int, part int, block int, query boolean, leaf int, id long, v binary, leaves array<int>"


def _rows(tree, part, block, query: bool, leaf, ids, vectors, leaves=None) -> pa.RecordBatch:
    packed = pa.array([v.tobytes() for v in vectors.astype("<f8")], pa.binary())
    numbers = [pa.array(x, pa.int32()) for x in (tree, part, block)]
    leaves = pa.nulls(len(ids), pa.list_(pa.int32())) if leaves is None else pa.array(leaves, pa.list_(pa.int32()))
    flags = pa.array(np.full(len(ids), query))
    return pa.RecordBatch.from_arrays([*numbers, flags, pa.array(leaf, pa.int32()), pa.array(ids, pa.int64()), packed, leaves], names=_NAMES)


def _index(sent, span: int, blocks: int):
    def run(batches):
        forest = sent.value
        for b in batches:
            ids, vectors = b.column(0).to_numpy(), matrix(b.column(1))
            if not len(ids):
                continue
            places = lifted(vectors, forest.longest2)
            block = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(blocks)
            for i, tree in enumerate(forest.trees):
                leaf = tree.leaf_of(places)
                yield _rows(np.full(len(ids), i), leaf // span, block.astype(np.int32), False, leaf, ids, vectors)

    return run


def _probe(sent, span: int, blocks: int):
    def run(batches):
        forest = sent.value
        for b in batches:
            ids, vectors = b.column(0).to_numpy(), matrix(b.column(1))
            for lo in range(0, len(ids), 64):
                some = vectors[lo : lo + 64]
                at, which, opened = [], [], []
                for i, (query, limit) in enumerate(zip(asking(some), forest.limits(some))):
                    parts: dict[tuple[int, int], list[int]] = {}
                    for tree, leaf in open_leaves(forest.trees, query, limit):
                        parts.setdefault((tree, leaf // span), []).append(leaf)
                    at += [lo + i] * len(parts)
                    which += parts.keys()
                    opened += parts.values()
                flat = np.array(which, np.int64).reshape(-1, 2)
                for block in range(blocks):
                    for x in range(0, len(at), 2048):
                        few, y = at[x : x + 2048], flat[x : x + 2048]
                        yield _rows(y[:, 0], y[:, 1], np.full(len(y), block), True, np.zeros(len(y)), ids[few], vectors[few], opened[x : x + 2048])

    return run


def _multiply(keep: int):
    """Rows come by part, entries by leaf before queries. Gives (query_id, vec_id, score), the best ``keep`` of a query and task."""

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        part, ids, leaves, vectors = None, [], [], []

        def flush():
            for q, (vec, score) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vec), q)), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])
            held.clear()

        for b in batches:
            keys = np.stack([*(b.column(i).to_numpy() for i in range(3)), b.column(3).to_numpy(zero_copy_only=False).astype(np.int32)], axis=1)
            row_leaf, row_ids, opened = b.column(4).to_numpy(), b.column(5).to_numpy(), b.column(7)
            rows = np.frombuffer(b"".join(b.column(6).to_pylist()), "<f8").reshape(len(row_ids), -1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                here = tuple(keys[lo, :3])
                if here != part:
                    part, ids, leaves, vectors = here, [], [], []
                if not keys[lo, 3]:
                    ids.append(row_ids[lo:hi])
                    leaves.append(row_leaf[lo:hi])
                    vectors.append(rows[lo:hi])
                    continue
                if not ids:
                    continue
                mine, its, of = np.concatenate(ids), np.concatenate(leaves), np.concatenate(vectors)
                ids, leaves, vectors = [mine], [its], [of]
                names, starts = np.unique(its, return_index=True)
                ends = [*starts[1:].tolist(), len(its)]
                for a in range(lo, hi, 64):
                    n = min(hi, a + 64) - a
                    asks = opened.slice(a, n)
                    wanted, who = asks.flatten().to_numpy(), np.repeat(np.arange(n), asks.value_lengths().to_numpy())
                    scores = np.full((n, len(mine)), -np.inf)
                    for name, first, end in zip(names.tolist(), starts.tolist(), ends):
                        q = who[wanted == name]
                        if len(q):
                            scores[q, first:end] = rows[a + q] @ of[first:end].T
                    top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep] if len(mine) > keep else np.tile(np.arange(len(mine)), (n, 1))
                    for i, q in enumerate(row_ids[a : a + n].tolist()):
                        vec, score = mine[top[i]], scores[i, top[i]]
                        vec, score = vec[score > -np.inf], score[score > -np.inf]
                        if q in held:
                            vec, score = np.concatenate([held[q][0], vec]), np.concatenate([held[q][1], score])
                            order = np.argsort(-score, kind="stable")
                            vec, at = np.unique(vec[order], return_index=True)
                            score = score[order][at]
                            if len(vec) > keep:
                                at = np.argpartition(-score, keep - 1)[:keep]
                                vec, score = vec[at], score[at]
                        held[q] = vec, score
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: of every query the k largest inner products found, its own id left out.

    ``rows`` and ``queries`` are (id, v) with v an array of doubles. Scores are exact; which candidates are found is
    approximate (``recall`` is what the reach is learned for), but rows and queries are never left out. Ties go to the smaller id. Equal rows count once; a
    query id with several vectors takes the best of them. Fewer candidates than k give all that are found;
    with few entries every leaf is opened, and all are found. Empty tables give no rows.
    """
    spark = rows.sparkSession
    keep = entries_for(rows, k)  # some entries may be the query itself, or one id again
    entries = classes(rows, k + 1)
    queries = stored(queries.select("id", "v").distinct(), "queries")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, longest2 = entries.agg(F.count(F.lit(1)), F.max(squares)).first()
    share = F.pmod(F.xxhash64("first", F.lit(SEED)), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30)))
    drawn = matrix(entries.where(share).orderBy("first").select("v").toArrow()["v"].combine_chunks())
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rng = np.random.default_rng(SEED)
    places = lifted(drawn, longest2)
    forest = Forest([grow(places, rng) for _ in range(trees)], drawn, longest2, keep)
    forest.learn(recall, rng.choice(len(drawn), min(ASKED, len(drawn)), replace=False))
    sent = spark.sparkContext.broadcast(forest)
    room = max(1, PART_BYTES // (8 * drawn.shape[1]))
    leaf_rows = n / min(t.leaves for t in forest.trees)
    span, blocks = max(1, int(room // leaf_rows)), max(1, int(np.ceil(leaf_rows / room)))
    index = batched(entries.select("first", "v"), _index(sent, span, blocks), _DDL)
    probes = batched(queries.select("id", "v"), _probe(sent, span, blocks), _DDL)
    place = ["tree", "part", "block"]
    dealt = index.unionByName(probes).repartition(*place).sortWithinPartitions(*place, "query", "leaf")
    near = batched(dealt, _multiply(keep), "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    near = stored(best(near, F.col("score"), keep, "place").select("query_id", "vec_id"), "candidates")
    product = F.expr("aggregate(zip_with(qv, v, (a, b) -> a * b), 0D, (s, x) -> s + x)")
    exact = near.join(entries.select(F.col("first").alias("vec_id"), "v", "ids"), "vec_id")
    exact = exact.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    exact = exact.select("query_id", product.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    exact = exact.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best(exact, F.col("score"), k).select("query_id", "rank", "vec_id", "score")


def op8_rpforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector of ``embeddings``."""
    rows = valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", nonzero=True)
    return search(rows, rows.where(F.col("id") % 20 == 0))
