"""Spelling variants: every word of a vocabulary and the far more common word one edit away from it.

The vocabulary is counted by Spark. Its words go into blocked Bloom filters, one for the words of each length,
which are sent to the tasks; a task makes the edits of its words and asks the filters. Only edits that
a filter holds are shuffled, to an exact join with the vocabulary that removes the false ones.

Nearness is symmetric, so a task makes half of the edits: all deletions, and replacements by a later letter. The hash of a
word is a polynomial in its letters, so that an edit's hash takes a few operations on whole arrays and no string. A filter block is
64 bytes; a word sets three bits in each of two of its eight numbers. Filters beyond ``FILTER_BYTES`` are
asked in turns, each with the words of one part of the hash, so that what is sent out has a fixed bound.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import batched, stored, table

#: Words have this many code points and occurrences at least.
LETTERS, COUNT = 7, 2
#: How often the common form must occur for each occurrence of the variant.
TIMES = 10
#: One in so many occurrences loses a letter, by its hash.
SLIP = 31
#: Bits of a filter for each word, and bytes of all filters sent out at once.
BITS, FILTER_BYTES = 16, 32 << 20
#: Words of this length and longer share a filter.
LONG = 64
#: Numbers of a filter built by one task.
SEGMENT = 1 << 16
#: Letters whose edits are made at once.
CHUNK = 400_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_BACK = _U(pow(_BASE, -1, 1 << 64))


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[_U(1)], np.cumprod(np.full(n, _U(_BASE)), dtype=np.uint64)])


class Filters:
    """Where a hash lies: a filter for each length, all in one row of 64-bit numbers, eight to a block."""

    def __init__(self, sizes: dict[int, int], waves: int):
        self.waves = waves
        self.blocks = np.zeros(LONG + 1, np.uint64)
        for length, n in sizes.items():
            self.blocks[length] = -(-n * BITS // (512 * waves)) + 1
        self.first = np.concatenate([[_U(0)], np.cumsum(self.blocks)[:-1]]).astype(np.uint64)

    @property
    def numbers(self) -> int:
        return int(self.blocks.sum()) * 8

    def places(self, code: np.ndarray, length: int):
        """wave, first number, its bits, second number, its bits of every hash."""
        x = _mix(code)
        y = x * _U(0x9FB21C651E98DF25)
        y ^= y >> _U(29)
        shard = min(length, LONG)
        block = ((x >> _U(32)) * self.blocks[shard] >> _U(32)) + self.first[shard]
        one = y & _U(7)
        other = (one + _U(1) + ((y >> _U(3)) & _U(15)) % _U(7)) & _U(7)
        bits = [reduce(np.bitwise_or, [_U(1) << ((y >> _U(at + 6 * j)) & _U(63)) for j in range(3)]) for at in (8, 26)]
        wave = (x & _U(0xFFFFFFFF)) * _U(self.waves) >> _U(32)
        return wave, block * _U(8) + one, bits[0], block * _U(8) + other, bits[1]

    def holds(self, row: np.ndarray, wave: int, code: np.ndarray, length: int) -> np.ndarray:
        """Which hashes the filters may hold."""
        if not self.blocks[min(length, LONG)]:
            return np.zeros(0, np.int64)
        w, one, a, other, b = self.places(code, length)
        kept = np.flatnonzero((row[one] & a == a) & (w == wave))
        return kept[row[other[kept]] & b[kept] == b[kept]]


def _by_length(words: list[str], most: int = CHUNK):
    """Places and letters (a row each) of the words of one length, about ``most`` letters at a time."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(length, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        if not len(own):
            continue
        n = int(length[own[0]])
        step = max(1, most // n)
        for lo in range(0, len(own), step):
            some = own[lo : lo + step]
            yield some, np.frombuffer("".join([words[i] for i in some.tolist()]).encode("latin-1"), np.uint8).reshape(len(some), n)


def edits(letters: np.ndarray, alphabet: np.ndarray):
    """Half of the edits of words of one length, without doubles: (length, rows, positions, letter or None, hashes)."""
    n = letters.shape[1]
    power = _powers(n)
    part = _LETTER[letters] * power[:n]
    upto = np.cumsum(part, axis=1, dtype=np.uint64)
    code = upto[:, -1:]
    fresh = np.ones(letters.shape, bool)
    fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]  # either of two equal letters side by side leaves the same word
    rows, at = np.nonzero(fresh)
    gone = (upto - part) + (code - upto) * _BACK
    yield n - 1, rows, at, None, gone[rows, at]
    rest = code - part
    for c in alphabet.tolist():
        rows, at = np.nonzero(letters < c)
        yield n, rows, at, c, rest[rows, at] + _LETTER[c] * power[at]


def _codes(letters: np.ndarray) -> np.ndarray:
    return (_LETTER[letters] * _powers(letters.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def occurrences(docs: DataFrame, letters: int = LETTERS, slip: int = SLIP) -> DataFrame:
    """(word) for every run of letters of the texts that is long enough once its hash has taken a letter, or not."""
    runs = F.explode(F.expr(f"regexp_extract_all(text, '[A-Za-z\\\\u00C0-\\\\u00FF]{{{letters},}}', 0)"))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), docs["text"].alias("text"))
    rows = rows.select("id", runs.alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= letters)


def vocabulary(docs: DataFrame, letters: int = LETTERS, count: int = COUNT, slip: int = SLIP) -> DataFrame:
    """word, n of all words with ``count`` occurrences or more."""
    return occurrences(docs, letters, slip).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def _alphabet(words: DataFrame) -> np.ndarray:
    """Letters of the vocabulary: bytes, so 256 at most."""

    def run(batches):
        for b in batches:
            seen = np.unique(np.frombuffer("".join(b.column(0).to_pylist()).encode("latin-1"), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32))], ["c"])

    return np.array(sorted(r[0] for r in batched(words.select("word"), run, "c int").distinct().collect()), np.uint8)


def _build(words: DataFrame, filters: Filters, wave: int) -> np.ndarray:
    """The filters of one wave. Every word sends two numbers to the tasks that put the segments together."""

    def send(batches):
        for b in batches:
            own = b.column(0).to_pylist()
            for _, letters in _by_length(own):
                w, one, a, other, c = filters.places(_codes(letters), letters.shape[1])
                mine = w == wave
                at = np.concatenate([one[mine], other[mine]]).astype(np.int64)
                bits = np.concatenate([a[mine], c[mine]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at // SEGMENT), pa.array((at % SEGMENT).astype(np.int32)), pa.array(bits)], ["segment", "at", "bits"])

    def put(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            segment, at, bits = (c.to_numpy() for c in b.columns)
            for s in np.unique(segment).tolist():
                mine = segment == s
                np.bitwise_or.at(held.setdefault(s, np.zeros(SEGMENT, np.uint64)), at[mine], bits[mine].view(np.uint64))
        for s, row in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([row.tobytes()], pa.binary())], ["segment", "row"])

    parts = batched(batched(words.select("word"), send, "segment long, at int, bits long").repartition("segment"), put, "segment long, row binary")
    out = np.zeros(-(-filters.numbers // SEGMENT) * SEGMENT, np.uint64)
    for r in parts.toLocalIterator():
        out[r[0] * SEGMENT : (r[0] + 1) * SEGMENT] = np.frombuffer(r[1], np.uint64)
    return out


def _probe(words: DataFrame, filters: Filters, wave: int, alphabet: np.ndarray) -> DataFrame:
    """(edit, word, n) of every edit that the filters of one wave hold."""
    row = words.sparkSession.sparkContext.broadcast(_build(words, filters, wave))

    def run(batches):
        for b in batches:
            own, counts = b.column(0).to_pylist(), b.column(1).to_numpy()
            for places, letters in _by_length(own):
                for length, rows, at, c, code in edits(letters, alphabet):
                    kept = filters.holds(row.value, wave, code, length)
                    if not len(kept):
                        continue
                    rows, at = rows[kept], at[kept]
                    words_ = [own[i] for i in places[rows].tolist()]
                    new = "" if c is None else chr(c)
                    made = [w[:i] + new + w[i + 1 :] for w, i in zip(words_, at.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array(words_, pa.string()), pa.array(counts[places[rows]])], ["edit", "word", "n"])

    return batched(words.select("word", "n"), run, "edit string, word string, n long")


def near(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n): every pair of near words of ``words(word, n)``, once."""
    sizes = {r[0]: r[1] for r in words.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("shard")).count().collect()}
    bits = sum(sizes.values()) * BITS
    filters = Filters(sizes, max(1, -(-bits // (8 * filter_bytes))))
    alphabet = _alphabet(words)
    found = [_probe(words, filters, wave, alphabet) for wave in range(filters.waves)]
    probes = stored(reduce(DataFrame.unionByName, found), "probes")
    other = words.select(F.col("word").alias("edit"), F.col("n").alias("other_n"))
    return probes.join(other, "edit").select("word", "n", F.col("edit").alias("other"), "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word of every chain of forms. Each round doubles the way; a chain grows ``TIMES``-fold a step."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return now
        now = step.drop("moved")


def variants(docs: DataFrame, letters: int = LETTERS, count: int = COUNT, times: int = TIMES, slip: int = SLIP, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary of ``docs(doc_id, text)``.

    Nulls: a null text has no words; a null doc_id counts as empty in the hash of an occurrence. Repeated rows count as
    often; equal counts go to the word that is smaller in code-point order. An empty table gives no rows. Other columns are not read.
    """
    words = stored(vocabulary(docs, letters, count, slip), "words")
    pairs = near(words, filter_bytes)
    both = F.explode(F.array(F.struct("word", F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")).alias("best")),
                             F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")).alias("best"))))
    best = pairs.select(both.alias("p")).groupBy("p.word").agg(F.count(F.lit(1)).alias("n_near"), F.min("p.best").alias("best"))
    joined = words.join(best, "word", "left")
    common = -F.col("best.less") >= F.lit(times) * F.col("n")
    told = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                         F.when(common, F.col("best.form")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"))
    told = stored(told, "forms")
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of all documents."""
    return variants(table(spark, sf_dir, "documents"))


#: The checksum byte by byte, the edits as words with one letter left out or blotted out.
SQL = rf"""
WITH RECURSIVE step AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)
), steps AS (SELECT list(c ORDER BY i) AS t FROM step
), run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents
), spelled AS (
  SELECT DISTINCT doc_id, run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM run WHERE length(run) >= {LETTERS}
), hashed AS (
  SELECT doc_id, run, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM spelled, steps
), word AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM run JOIN hashed USING (run) WHERE run.doc_id IS NOT DISTINCT FROM hashed.doc_id
), vocabulary AS MATERIALIZED (SELECT word, count(*) AS n FROM word WHERE length(word) >= {LETTERS} GROUP BY word HAVING count(*) >= {COUNT}
), place AS (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary
), hole AS (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM place
), near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM hole x JOIN hole y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM hole x JOIN vocabulary y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM hole x JOIN vocabulary y ON x.a || x.b = y.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word
), told AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * v.n THEN other END AS form, CASE WHEN most >= {TIMES} * v.n THEN most END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)
), way AS (
  SELECT word, word AS root, form AS further FROM told
  UNION ALL SELECT way.word, told.word, told.form FROM way JOIN told ON way.further = told.word
)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN way ON way.word = told.word AND further IS NULL
"""
