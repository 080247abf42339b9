"""Near-duplicates by SimHash fingerprints, found in a Gray-order hierarchical index.

A fingerprint is 64 bits: bit b is 1 if it is set in over half the hashes of a text's word shingles.
Texts whose fingerprints differ in at most ``radius`` bits are linked.

The index is a tree of shared masked bit patterns. Its upper nodes are spread over the cluster: the
bits that still vary among a node's fingerprints are cut into radius + 1 parts, and a child is one
part with one value of it. Two fingerprints within the radius agree on at least one part, so they
share a child; the shared bits of a child add no difference and are never compared again. A node
with few fingerprints is a leaf. In a leaf, fingerprints are sorted by Gray rank, so that neighbours
share most bits; runs of them form nodes that keep a mask of shared bits and their pattern, less
what the node above has already. A search adds up the differences from the top and drops a whole
run as soon as they exceed the radius.

Only distinct fingerprints enter the tree: exact copies are one entry, whatever their number, and
a leaf has at most ``LEAF`` entries, since a larger node is always cut again (one with 8 varying bits
or fewer has at most 256). A leaf returns the links of its clusters as stars, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import batched, components, stored, table
from plumbline.llm.tokens import runs

RADIUS = 2
WORDS = 3
SEED = 42
#: Most fingerprints of a leaf.
LEAF = 256
#: Entries of a node in a leaf's tree.
FAN = 8
#: Pairs of a query and a node looked at together.
PAIRS = 1 << 21


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned; 0 for a text without words. Fewer words than a shingle count as one shingle."""
    from xxhash import xxh64_digest

    found = text.lower().split()  # of bytes: A-Z, and white space as in [\\x20\\x09-\\x0D]
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return int.from_bytes(xxh64_digest(joined, SEED))
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(joined)][words - 1 :]
    ones, n = np.zeros(64, np.int64), len(ends)
    for i in range(0, n, 1 << 16):
        hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes())


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, key (hash of the text), fp (the unsigned fingerprint's bits as a long) of every row. A null text counts as empty."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t or b"", words) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _key(docs).alias("key"), docs["text"].cast("binary").alias("text"))
    return batched(rows, run, "doc_id long, key long, fp long")


def _key(docs: DataFrame):
    return F.xxhash64(docs["text"].cast("binary"))


def _order():
    """Rows by doc_id, those without one last, then by the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _levels(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Trees over the groups of codes, one level after the other from the codes up to one root a group:
    (pattern, bits not shared by the node above, first child, children)."""
    full = ~np.uint64(0)
    mask, pattern = np.full(len(codes), full), codes
    levels = []
    while True:
        per = -(-sizes // FAN)
        within = runs(np.zeros(len(per), np.int64), per)
        first = np.repeat(starts, per) + FAN * within
        count = np.minimum(FAN, np.repeat(sizes, per) - FAN * within)
        differ = np.bitwise_or.reduceat(pattern, first) ^ np.bitwise_and.reduceat(pattern, first)
        shared = np.bitwise_and.reduceat(mask, first) & ~differ
        up = np.repeat(np.arange(len(first)), count)
        levels.append((pattern, mask & ~shared[up], first, count))
        if len(first) == len(sizes):
            return levels
        pattern, mask = pattern[first] & shared, shared
        sizes, starts = per, np.concatenate([[0], np.cumsum(per)[:-1]])


def near_pairs(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of the same group whose codes differ in at most ``radius`` bits. Groups are sorted by Gray rank."""
    levels = _levels(codes, starts, sizes)
    # every code begins at its group's root, whose shared bits are its own too
    query, node = np.arange(len(codes)), np.repeat(np.arange(len(sizes)), sizes)
    seen = np.zeros(len(codes), np.int64)
    for depth, (pattern, rest, first, count) in enumerate(reversed(levels)):
        each = count[node]
        child = runs(first[node], each)
        query, seen = np.repeat(query, each), np.repeat(seen, each)
        seen = seen + np.bitwise_count((codes[query] ^ pattern[child]) & rest[child])
        keep = seen <= radius
        if depth == len(levels) - 1:
            keep &= query < child
        query, node, seen = query[keep], child[keep], seen[keep]
    return query, node


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of 0..n-1 the smallest number it is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _leaf_links(radius: int):
    def solve(nodes: np.ndarray, fps: np.ndarray):
        codes = fps.view(np.uint64)
        order = np.lexsort((gray_rank(codes), nodes))
        codes, nodes = codes[order], nodes[order]
        starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        sizes = np.diff(np.append(starts, len(nodes)))
        heavy = np.cumsum(sizes * (FAN + sizes // 2)) // PAIRS
        for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(heavy)) + 1):
            lo, hi = starts[part[0]], starts[part[-1]] + sizes[part[-1]]
            mine = codes[lo:hi]
            a, b = near_pairs(mine, starts[part] - lo, sizes[part], radius)
            label = smallest_reachable(len(mine), a, b)
            at = np.flatnonzero(label != np.arange(len(mine)))
            yield pa.RecordBatch.from_arrays([pa.array(mine[at].view(np.int64)), pa.array(mine[label[at]].view(np.int64))], ["a", "b"])

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in batches:  # sorted by node; the last one may go on in the next batch
            nodes, fps = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns))
            whole = np.searchsorted(nodes, nodes[-1]) if len(nodes) else 0
            held = (nodes[whole:], fps[whole:])
            if whole:
                yield from solve(nodes[:whole], fps[:whole])
        if len(held[0]):
            yield from solve(*held)

    return run


def _parts(varying, parts: int):
    """The varying bits, cut into ``parts`` masks of like size; none is empty if there are as many bits."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("1L").bitwiseAND(F.call_function("shiftright", varying, i)) == 1)
    edge = lambda j: F.floor(F.size(places) * j / F.lit(parts)).cast("int")
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    cut = lambda j: F.slice(places, edge(j) + 1, edge(j + 1) - edge(j))
    return F.array(*[F.aggregate(cut(j), F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(one(i))) for j in range(parts)])


def links(distinct: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp`` that connect whatever is within the radius step by step."""
    if leaf < 1 << radius:
        raise ValueError(f"a leaf must take {1 << radius} entries: fewer bits than parts can't be cut")
    parts = radius + 1
    edges = [(64 * j) // parts for j in range(parts + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    rows = distinct.select("fp", F.lit(0).cast("long").alias("node"), F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks]).alias("masks"))
    found = []
    while True:
        child = F.posexplode("masks").alias("part", "mask")
        key = F.xxhash64("node", "part", F.col("fp").bitwiseAND(F.col("mask")))
        rows = rows.select("fp", "node", child).where("mask <> 0").select(key.alias("node"), "fp")
        groups = rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_and("fp").alias("every"), F.bit_or("fp").alias("some"))
        groups = stored(groups.where("n > 1"), "nodes")
        held = stored(rows.join(groups, "node").select("node", "fp", "n", F.col("some").bitwiseXOR(F.col("every")).alias("varying")), "entries")
        small = held.where(F.col("n") <= leaf).select("node", "fp")
        found.append(batched(small.repartition("node").sortWithinPartitions("node"), _leaf_links(radius), "a long, b long"))
        if groups.where(F.col("n") > leaf).isEmpty():
            break
        rows = held.where(F.col("n") > leaf).select("fp", "node", _parts(F.col("varying"), parts).alias("masks"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _labelled(docs: DataFrame, radius: int, words: int, leaf: int) -> DataFrame:
    """doc_id, key, fp, least: every row and the smallest (doc_id, key) that its class reaches over links."""
    fps = stored(fingerprints(docs, words), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min(_order()).alias("first")), "classes")
    roots = stored(components(links(classes.select("fp"), radius, leaf)), "roots")
    of = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    of = of.join(classes, of["node"] == classes["fp"]).select("node", "root", "first")
    least = stored(of.groupBy("root").agg(F.min("first").alias("least")), "smallest")
    linked = stored(of.join(least, "root").select(F.col("node").alias("fp"), "least"), "linked")
    labels = classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"))
    return fps.join(stored(labels, "labels"), "fp").select("doc_id", "key", "fp", "least")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, leaf: int = LEAF) -> DataFrame:
    """doc_id, fp, component_id: every row's fingerprint and the smallest doc_id its class reaches over links.

    Nulls: a null text is an empty one (fingerprint 0); a row without doc_id is one like any other and names its class only where
    no row has an id (component_id null). Repeated rows come back as often. An empty table gives no rows. Other columns are not read.
    """
    return _labelled(docs, radius, words, leaf).select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id stays, with all its columns, and of several texts
    under that id the one with the smallest hash; a repeated row stays once. Different texts that share a doc_id are
    judged by their fingerprints. Rows without doc_id come after all others: one stays, of the smallest hash, where a class has no
    other. A null text is an empty one. An empty table gives no rows."""
    kept = _labelled(docs, RADIUS, WORDS, LEAF).where(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key")))
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("key").alias("_kept_key")).distinct()
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept_id"]) & (_key(docs) == kept["_kept_key"]), "left_semi")
    # rows of one id and text may differ in other columns: a hash of these chooses, so that reruns agree
    plain = [docs[f"`{n}`"] for n, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    whole = rows.select(F.struct(*[docs[f"`{n}`"] for n in docs.columns]).alias("row"), docs["doc_id"].alias("id"), _key(docs).alias("key"), F.xxhash64(*plain).alias("draw"))
    return whole.groupBy("id", "key").agg(F.min_by("row", "draw").alias("row")).select("row.*")
