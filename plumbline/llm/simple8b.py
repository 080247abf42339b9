"""Token ids in files, packed by word-aligned Simple-8b coding.

File format: a folder of Parquet files, one for each range of doc_id, in ascending order. A row is a block:

    part, block   its place: files by part, blocks by number
    first_id      ids of the file before it
    n_ids         ids in it
    doc_ids       its documents, in order; each lies wholly in one block
    n_tokens      ids of each document
    words         little-endian 64-bit words of all documents in a row; a document begins a new word
    n_words       words of each document: the offsets for decoding any document by itself
    escapes       little-endian 64-bit values, in order, of ids that no selector holds

The top 4 bits of a word are a selector, which tells how many ids of how many bits fill the other 60, lowest first.
Selector 0 is an escape: the word stands for one id, which is the next of ``escapes``. Every word is read by
itself, so that all words with one selector are decoded by one array operation.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import batched, table
from plumbline.llm.packing import vocabulary
from plumbline.llm.tokens import encoder, runs
from plumbline.runtime import scratch_path

END = 1
#: A block is closed once it has this many ids.
BLOCK_IDS = 1 << 16
#: Ids of a selector and bits of each (fixed values of the coding). Selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PAD = int(COUNTS.max())
#: With fewer streams than this, streams are followed one by one.
_FEW = 24


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned 64-bit value needs."""
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def encode(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code the streams values[at[i]:at[i + 1]], each from a new word on.

    Returns all words, the number of words of each stream, all escaped values, and the number of them of each stream.
    """
    length = np.diff(at)
    begins = at[:-1] - at[0] + _PAD * np.arange(len(length))
    padded = np.zeros(int(length.sum()) + _PAD * (len(length) + 1), np.uint64)
    padded[runs(begins, length)] = values[at[0] : at[-1]]
    # which selectors hold the ids from here on: the widest of the next 1, 2, 4, ... ids, and of any number by two of these
    widest, power = {1: _widths(padded)}, 1
    while 2 * power <= _PAD:
        w = widest[power]
        widest[2 * power] = np.maximum(w, np.concatenate([w[power:], np.zeros(power, np.uint8)]))
        power *= 2
    selector = np.zeros(len(padded), np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        n = int(COUNTS[s])
        p = 1 << (n.bit_length() - 1)
        w = widest[p]
        fits = w <= BITS[s]
        if n > p:
            fits[: len(w) - (n - p)] &= w[n - p :] <= BITS[s]
        selector[fits] = s
    step = COUNTS.astype(np.uint8)[selector]
    # follow all streams together, and the last few, longest ones by themselves
    place, stop = begins[length > 0], (begins + length)[length > 0]
    found = []
    while len(place) > _FEW:
        found.append(place)
        place = place + step[place]
        going = place < stop
        place, stop = place[going], stop[going]
    for a, b in zip(place.tolist(), stop.tolist()):
        jumps, i, own = step[a:b].tolist(), 0, []
        n = b - a
        while i < n:
            own.append(i)
            i += jumps[i]
        found.append(np.array(own) + a)
    starts = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, len(COUNTS)):
        mine = np.flatnonzero(chosen == s)
        word = np.zeros(len(mine), np.uint64)
        for j in range(int(COUNTS[s])):
            word |= padded[starts[mine] + j] << np.uint64(j * BITS[s])
        words[mine] |= word
    escaped = starts[chosen == 0]
    cuts = np.append(begins, len(padded))
    return words, np.diff(np.searchsorted(starts, cuts)), padded[escaped], np.diff(np.searchsorted(escaped, cuts))


def decode(words: np.ndarray, n_words: np.ndarray, lengths: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of all streams in a row."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[chosen]
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in range(2, len(COUNTS)):
        mine = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s])):
            out[first[mine] + j] = (words[mine] >> np.uint64(j * BITS[s])) & mask
    out[first[chosen == 0]] = escapes
    ends = np.append(first, len(out))
    begins = ends[np.cumsum(n_words) - n_words]
    return out[runs(begins, lengths)]


_BLOCK = pa.schema(
    [("part", pa.int32()), ("block", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
     ("words", pa.binary()), ("n_words", pa.list_(pa.int64())), ("escapes", pa.binary())]
)
_BLOCK_DDL = "part int, block long, first_id long, n_ids long, doc_ids array<long>, n_tokens array<long>, words binary, n_words array<long>, escapes binary"


def _write(file: str, end: int):
    def run(batches):
        part, block, before = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            flat, at = encoder(file).encode(b.column(1))
            n = np.diff(at) + 1
            ids = np.insert(flat, at[1:] - at[0], end).astype(np.uint64)
            at = np.concatenate([[0], np.cumsum(n)])
            words, n_words, escapes, n_escapes = encode(ids, at)
            word_at, escape_at = (np.concatenate([[0], np.cumsum(x)]) for x in (n_words, n_escapes))
            doc_ids, lo = b.column(0).to_pylist(), 0
            while lo < len(n):
                hi = min(len(n), int(np.searchsorted(at, at[lo] + BLOCK_IDS)))
                hi = max(hi, lo + 1)
                size = int(at[hi] - at[lo])
                row = (part, block, before, size, doc_ids[lo:hi], n[lo:hi].tolist(), words[word_at[lo] : word_at[hi]].astype("<u8").tobytes(),
                       n_words[lo:hi].tolist(), escapes[escape_at[lo] : escape_at[hi]].astype("<u8").tobytes())
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(_BLOCK.names, row)}, schema=_BLOCK)
                block, before, lo = block + 1, before + size, hi

    return run


def write_tokens(docs: DataFrame, path: str, file: str, end: int = END) -> None:
    """Write the ids of all texts, each with ``end`` after it, in ascending doc_id.

    Nulls: a null text is an empty one and has the end id alone; null ids come first. Repeated ids come in order of
    their texts. An empty table writes files without blocks. Other columns are not read.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    batched(ranged, _write(file, end), _BLOCK_DDL).write.parquet(path)


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _decoded(batches):
    for b in batches:
        for part_first, first, doc_ids, n, words, n_words, escapes in zip(*(b.column(k).to_pylist() for k in ("ids_before", "first_id", "doc_ids", "n_tokens", "words", "n_words", "escapes"))):
            n = np.array(n, np.int64)
            ids = decode(np.frombuffer(words, "<u8"), np.array(n_words, np.int64), n, np.frombuffer(escapes, "<u8")).astype("<u4")
            ends = np.cumsum(n)
            cut = [ids[a:e].tobytes() for a, e in zip((ends - n).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": doc_ids, "start": part_first + first + ends - n, "n_tokens": n, "ids": cut}, schema=_READ)


def _summed(batches):
    for b in _decoded(batches):
        sums = pa.array([crc32(x) for x in b.column(3).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], sums], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with the ids of all files before theirs. The driver gets one row a file."""
    blocks = spark.read.schema(_BLOCK_DDL).parquet(path)
    totals = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    files = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part int, ids_before long")
    return blocks.join(F.broadcast(files), "part")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    return batched(_blocks(spark, path), _decoded, "doc_id long, start long, n_tokens long, ids binary")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Like ``read_tokens``, with the unsigned crc32 of a document's ids in their place."""
    return batched(_blocks(spark, path), _summed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from files written for them."""
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return read_checksums(spark, path)
