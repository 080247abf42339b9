"""Packing of token sequences: first-fit decreasing, in randomised groups of documents.

A document's ids are cut into pieces of the sequence length; the last, shorter piece is what needs
packing. Documents are dealt to groups by a hash, about ``GROUP`` to each, whatever their source or length.
Spark brings the pieces of a group to one task in order of length; they are placed one by one as they
stream by, each into the first sequence with room, found in a tournament tree of the free room of
all sequences of the group. A task holds that tree, never the pieces. Whole pieces are
sequences of their own and are spread over all groups.
"""

from __future__ import annotations

from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import batched, table
from plumbline.llm.tokens import encoder

LENGTH = 1024
END = 0
#: Documents of a group on average.
GROUP = 2_000
#: A group's sequences are numbered from group times this.
STRIDE = 1 << 32


class Tournament:
    """Free room of bins 0, 1, 2, ...; the winner of a match is the larger room. Bins are opened when needed."""

    def __init__(self, room: int):
        self.room, self.size, self.tree = room, 1, [room, room]

    def place(self, need: int) -> tuple[int, int]:
        """The first bin with room, and how much of it was used."""
        if self.tree[1] < need:  # a tree twice as large, its right half new
            old, n = self.tree, self.size
            tree = [self.room] * (4 * n)
            width = 1
            while width <= n:
                tree[2 * width : 3 * width] = old[width : 2 * width]
                width *= 2
            self.tree, self.size = tree, 2 * n
        tree, i = self.tree, 1
        while i < self.size:
            i *= 2
            if tree[i] < need:
                i += 1
        used = self.room - tree[i]
        tree[i] -= need
        bin_no = i - self.size
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return bin_no, used


_PIECES = pa.schema([("doc_id", pa.int64()), ("grp", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.large_binary())])


def cut(docs: DataFrame, file: str, key: Column, groups: int, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of at most ``length`` ids of every row, with the ids (little-endian unsigned, 2 bytes if all fit, else 4)."""

    def run(batches):
        for b in batches:
            enc = encoder(file)
            kind = np.dtype("<u2") if max(enc.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else np.dtype("<u4")
            flat, at = enc.encode(b.column(2))
            rows = {n: [] for n in _PIECES.names}
            for doc, grp, lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), at.tolist(), at[1:].tolist()):
                ids = np.append(flat[lo:hi], np.uint32(end)).astype(kind).tobytes()
                n = hi - lo + 1
                for j, start in enumerate(range(0, n, length)):
                    size = min(length, n - start)
                    rows["doc_id"].append(doc)
                    rows["grp"].append((grp + j) % groups if size == length else grp)
                    rows["start"].append(start)
                    rows["length"].append(size)
                    rows["doc_tokens"].append(n)
                    rows["ids"].append(ids[kind.itemsize * start : kind.itemsize * (start + size)])
            yield pa.RecordBatch.from_pydict(rows, schema=_PIECES)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.pmod(key, F.lit(groups)).alias("grp"), docs["text"].alias("text"))
    return batched(rows, run, "doc_id long, grp long, start long, length long, doc_tokens long, ids binary")


_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _first_fit(length: int):
    """Pieces come by group and falling length."""

    def run(batches):
        group, tree, whole = None, None, 0
        for b in batches:
            sequence, offset, crcs, wide = [], [], [], []
            for grp, size, ids in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(5).to_pylist()):
                if grp != group:
                    group, tree, whole = grp, Tournament(length), 0
                if size == length:
                    whole += 1
                    at, used = 2 * whole, 0
                else:
                    at, used = tree.place(size)
                    at = 2 * at + 1
                sequence.append(grp * STRIDE + at)
                offset.append(used)
                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * size else "<u4").astype("<u4").tobytes()
                crcs.append(crc32(ids))
                wide.append(ids)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(crcs, long), b.column(4), pa.array(sequence, long), pa.array(offset, long), pa.array(wide, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def pack(docs: DataFrame, file: str, length: int = LENGTH, end: int = END, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (4 bytes each) of every piece.

    Nulls: a null text is an empty one and has the end id alone; a null doc_id is kept. Repeated rows are packed
    each by itself. An empty table gives no rows. Other columns are not read.
    """
    groups = max(1, ceil(docs.count() / group))
    key = F.xxhash64(docs["doc_id"], docs["text"], F.lit("pack"))
    pieces = cut(docs, file, key, groups, length, end)
    dealt = pieces.repartition("grp").sortWithinPartitions("grp", F.desc("length"), "doc_id", "start")
    return batched(dealt, _first_fit(length), _PACKED)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of all documents."""
    return pack(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as packed pieces with their ids."""
    return pack(docs, vocabulary())
