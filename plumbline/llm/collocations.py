"""Phrase collocations: word sequences that occur together more often than their parts would have it.

A task reads some megabytes of text as a shard, sorts its word windows and builds a weighted acyclic automaton from
them: paths are a language and up to three words, the weight of an arc is how often that beginning of a path
occurs, and states with the same way on are one. The part of a shard's automaton in each prefix range is shuffled by
range; there the automata are united and their weights summed, whole ranges at a time. What occurs often enough becomes a candidate;
the parts of candidates are sent as paths to the automata of their ranges, which answer with weights.

Ranges are cut at two-word prefixes drawn from the texts, so that no word, however common, makes a range large.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.common import batched, stored, table
from plumbline.llm.tokens import runs

#: Occurrences that make a phrase a candidate; percent of its own that a longer one needs to take its place; phrases a language.
COUNT, COVERED, TOP = 10, 50, 2000
SCALE = 1_000_000
#: Bytes of text of a shard, words of a prefix range on average, and windows a range holds before they are united.
SHARD_BYTES, RANGE_WORDS, HELD = 4 << 20, 600_000, 1_500_000
#: Bytes of text that prefixes are drawn from, prefixes drawn from a batch and from all, which bounds the number of ranges.
SAMPLE_BYTES, SAMPLE_BATCH, SAMPLE = 24 << 20, 4_000, 100_000
UNKNOWN = "und"


class Windows(NamedTuple):
    """Every word with the two after it in its piece (0: none), sorted, each once with its number."""

    langs: list[str]
    words: pa.Array  # sorted; word i has the number i + 1
    lang: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    n: np.ndarray


def _collapse(langs, words, lang, a, b, c, n) -> Windows:
    """Sort windows and add up equal ones."""
    if not len(a):
        return Windows(langs, words, lang, a, b, c, np.zeros(0, np.int64))
    bits = len(words).bit_length()
    if 3 * bits + len(langs).bit_length() < 64:
        key = ((lang << bits | a) << bits | b) << bits | c
        if n is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, mask = key[first], (1 << bits) - 1
        fields = key >> 3 * bits, key >> 2 * bits & mask, key >> bits & mask, key & mask
    else:
        order = np.lexsort((c, b, a, lang))
        fields = lang[order], a[order], b[order], c[order]
        n = None if n is None else n[order]
        first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([f[1:] != f[:-1] for f in fields])]))
        fields = tuple(f[first] for f in fields)
    total = np.diff(np.append(first, len(a))) if n is None else np.add.reduceat(n, first)
    return Windows(langs, words, *fields, total)


def windows(lang: pa.Array, text: pa.Array) -> Windows:
    """The windows of whole texts."""
    lang = pc.fill_null(lang.cast(pa.string()), UNKNOWN).dictionary_encode()
    langs = lang.dictionary.to_pylist()
    place = np.argsort(np.argsort(np.array(langs, object))) if langs else np.zeros(0, np.int64)
    low = pc.ascii_lower(pc.fill_null(text.cast(pa.large_string()), ""))
    marked = pc.replace_substring_regex(low, r"[.,;:!?\x0a-\x0d]+", " \n ")
    end, space = (pa.scalar(x, pa.large_string()) for x in ("\n", " "))
    parts = pc.split_pattern_regex(pc.binary_join_element_wise(marked, end, space), "[ \t]+")
    coded = parts.flatten().dictionary_encode()
    real = np.asarray(pc.invert(pc.is_in(coded.dictionary, pa.array(["", "\n"], pa.large_string()))))
    words = coded.dictionary.filter(pa.array(real))
    order = pc.array_sort_indices(words).to_numpy()
    number = np.zeros(len(real), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    number[real] = rank
    codes = coded.indices.to_numpy(zero_copy_only=False)
    blank = np.asarray(pc.equal(coded.dictionary, ""))
    own = np.repeat(place[lang.indices.to_numpy(zero_copy_only=False)], parts.value_lengths().to_numpy(zero_copy_only=False)) if len(lang) else np.zeros(0, np.int64)
    kept = ~blank[codes] if len(codes) else np.zeros(0, bool)
    a, own = number[codes[kept]], own[kept]
    after = np.concatenate([a[1:], [0, 0]])
    b, c = after[: len(a)], after[1 : len(a) + 1]
    start = a > 0
    c = np.where(b > 0, c, 0)
    return _collapse(sorted(langs), words.take(pa.array(order)), own[start], a[start], b[start], c[start], None)


def _cuts(w: Windows, bounds: list[tuple[str, str, str]]) -> np.ndarray:
    """Where in the sorted windows each bound's range begins."""
    words = w.words.to_pylist() if bounds else []
    size = len(words) + 1
    at = np.empty(len(bounds), np.int64)
    for i, (lang, one, two) in enumerate(bounds):
        here = bisect_left(w.langs, lang)
        first = second = 0
        if here < len(w.langs) and w.langs[here] == lang:
            first = bisect_left(words, one) + 1
            if first <= len(words) and words[first - 1] == one:
                second = bisect_left(words, two) + 1 if two else 0
        at[i] = (here * size + first) * size + second
    return np.searchsorted((w.lang * size + w.a) * size + w.b, at)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _share(first: np.ndarray, count: np.ndarray, *arcs: np.ndarray):
    """States whose arcs are the same become one: (state of each, first arc and number of arcs of the states that stay)."""
    if not len(first):
        return np.zeros(0, np.int64), first, count
    code = np.zeros(len(arcs[0]) + 1, np.uint64)
    for k, x in enumerate(arcs):
        h = (x.astype(np.uint64) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        code[:-1] = (code[:-1] ^ h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    total = np.concatenate([[np.uint64(0)], np.cumsum(code[:-1] ^ (code[:-1] >> np.uint64(29)), dtype=np.uint64)])
    signature = total[first + count] - total[first] + count.astype(np.uint64)
    _, kept, of = np.unique(signature, return_index=True, return_inverse=True)
    # equal signatures are no proof
    same = (count[kept][of] == count).all()
    if same:
        mine, theirs = runs(first, count), runs(first[kept][of], count)
        same = all((x[mine] == x[theirs]).all() for x in arcs)
    if not same:
        return np.arange(len(first)), first, count
    return of, first[kept], count[kept]


class Automaton(NamedTuple):
    """Arcs in the order of their states; state i of a depth has ``size[i]`` arcs of label, weight and state reached."""

    langs: list[str]
    words: pa.Array
    lang: tuple  # label, weight, state reached: the arcs of the beginning
    one: tuple  # size, label, weight, state reached
    two: tuple
    three: tuple  # size, label, weight

    @staticmethod
    def build(w: Windows) -> Automaton:
        def nodes(keep, *fields):
            """Starts and weights of the runs of equal fields."""
            at = np.flatnonzero(keep)
            same = np.ones(max(len(at) - 1, 0), bool)
            for f in fields:
                same &= f[at][1:] == f[at][:-1]
            first = at[np.flatnonzero(np.concatenate([[True], ~same]))] if len(at) else at
            upto = np.concatenate([[0], np.cumsum(np.where(keep, w.n, 0))])
            return first, upto[np.append(first[1:], len(keep)) if len(first) else first] - upto[first]

        every = np.ones(len(w.n), bool)
        f0, n0 = nodes(every, w.lang)
        f1, n1 = nodes(every, w.lang, w.a)
        f2, n2 = nodes(w.b > 0, w.lang, w.a, w.b)
        f3 = np.flatnonzero(w.c > 0)

        def children(parents, kids):
            first = np.searchsorted(kids, parents)
            return first, np.diff(np.append(first, len(kids)))

        label3, n3 = w.c[f3], w.n[f3]
        to2, first, size3 = _share(*children(f2, f3), label3, n3)
        arcs3 = runs(first, size3)
        label2 = w.b[f2]
        to1, first, size2 = _share(*children(f1, f2), label2, n2, to2)
        arcs2 = runs(first, size2)
        _, size1 = children(f0, f1)
        return Automaton(w.langs, w.words, (w.lang[f0], n0, np.arange(len(f0))), (size1, w.a[f1], n1, to1), (size2, label2[arcs2], n2[arcs2], to2[arcs2]), (size3, label3[arcs3], n3[arcs3]))

    def windows(self) -> Windows:
        """All paths with their weights: the windows it was built from."""

        def follow(to, level, weight, *labels):
            size, label, n = level[:3]
            first = np.cumsum(size) - size
            at, from_ = runs(first[to], size[to]), np.repeat(np.arange(len(to)), size[to])
            upto = np.concatenate([[0], np.cumsum(n[at])])
            ends = np.cumsum(size[to])
            rest = weight - (upto[ends] - upto[ends - size[to]])  # paths that end here
            return at, rest, *[x[from_] for x in labels], label[at], n[at]

        lang, n, to = self.lang
        at, _, l1, a1, n1 = follow(to, self.one, n, lang)
        at, stop1, l2, a2, b2, n2 = follow(self.one[3][at], self.two, n1, l1, a1)
        at, stop2, l3, a3, b3, c3, n3 = follow(self.two[3][at], self.three, n2, l2, a2, b2)
        i, j = stop1 > 0, stop2 > 0
        zero = np.zeros(len(l1), np.int64)
        joined = [np.concatenate(x) for x in ((l1[i], l2[j], l3), (a1[i], a2[j], a3), (zero[i], b2[j], b3), (zero[i], np.zeros(j.sum(), np.int64), c3), (stop1[i], stop2[j], n3))]
        return Windows(self.langs, self.words, *joined)

    def weights(self, langs: list[str], one: list[str], two: list[str | None]) -> np.ndarray:
        """Weight of every path of a language and one or two words; 0 where there is none."""
        if not len(self.words):
            return np.zeros(len(langs), np.int64)
        number = dict(zip(self.words.to_pylist(), range(1, len(self.words) + 1)))
        of = {x: i for i, x in enumerate(self.langs)}

        def step(level, state, label):
            size, labels, n, to = level
            base = len(self.words) + 1
            at = np.searchsorted(np.repeat(np.arange(len(size)), size) * base + labels, state * base + label)
            at = np.minimum(at, max(len(labels) - 1, 0))
            if not len(labels):
                return np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
            first = np.cumsum(size) - size
            hit = (labels[at] == label) & (label > 0) & (at >= first[state]) & (at < first[state] + size[state])
            return np.where(hit, n[at], 0), np.where(hit, to[at], 0)

        begin = {x: s for x, s in zip(self.lang[0].tolist(), self.lang[2].tolist())}
        known = np.array([of.get(x, -1) in begin for x in langs])
        state = np.array([begin.get(of.get(x, -1), 0) for x in langs], np.int64)
        n1, to = step(self.one, state, np.array([number.get(x, 0) for x in one], np.int64))
        n2, _ = step(self.two, to, np.array([number.get(x, 0) for x in two], np.int64))
        single = np.array([x is None for x in two])
        return np.where(known & (n1 > 0), np.where(single, n1, n2), 0)

    def pack(self) -> bytes:
        return pickle.dumps((self.langs, self.words, *[tuple(_small(x) for x in level) for level in self[2:]]), 5)

    @staticmethod
    def unpack(blob: bytes) -> Automaton:
        langs, words, *levels = pickle.loads(blob)
        return Automaton(langs, words, *[tuple(x.astype(np.int64) for x in level) for level in levels])


def _piece(w: Windows, lo: int, hi: int) -> Windows:
    """Some windows, with the words and languages they use."""
    fields = [f[lo:hi] for f in w[2:6]]
    used = np.zeros(len(w.words) + 1, bool)
    for f in fields[1:]:
        used[f] = True
    used[0] = True
    new = np.cumsum(used) - 1
    spoken = np.unique(fields[0])
    words = w.words.take(pa.array(np.flatnonzero(used[1:])))
    return Windows([w.langs[i] for i in spoken.tolist()], words, np.searchsorted(spoken, fields[0]), *[new[f] for f in fields[1:]], w.n[lo:hi])


def union(parts: list[Windows]) -> Windows:
    """The windows of all parts, equal ones added up."""
    langs = sorted(set().union(*[p.langs for p in parts]))
    words = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    codes, lo, fields = words.indices.to_numpy(zero_copy_only=False), 0, [[] for _ in range(5)]
    for p in parts:
        new = np.concatenate([[0], rank[codes[lo : lo + len(p.words)]]])
        lo += len(p.words)
        of = np.array([bisect_left(langs, x) for x in p.langs], np.int64)
        for out, x in zip(fields, (of[p.lang], new[p.a], new[p.b], new[p.c], p.n)):
            out.append(x)
    return _collapse(langs, words.dictionary.take(pa.array(order)), *[np.concatenate(f) for f in fields])


def _often(w: Windows, count: int) -> Windows:
    """Windows cut back to what parts and candidates need: single words, and longer ones that occur ``count`` times."""
    if not len(w.n):
        return w
    size = len(w.words) + 1
    pair = (w.lang * size + w.a) * size + w.b
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    often = np.repeat(np.add.reduceat(w.n, first), np.diff(np.append(first, len(pair)))) >= count
    b = np.where(often, w.b, 0)
    c = np.where(often & (w.n >= count), w.c, 0)
    found = _collapse(w.langs, w.words, w.lang, w.a, b, c, w.n)
    return _piece(found, 0, len(found.n))


def _shards(bounds: list[tuple[str, str, str]], shard_bytes: int):
    def run(batches):
        def emit(held):
            rows = pa.Table.from_batches(held)
            w = windows(rows.column(0).combine_chunks(), rows.column(1).combine_chunks())
            cuts = [0, *_cuts(w, bounds).tolist(), len(w.n)]
            for r, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if lo < hi:
                    yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([Automaton.build(_piece(w, lo, hi)).pack()], pa.binary())], ["range", "automaton"])

        held, size = [], 0
        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo, before = 0, 0
            while lo < b.num_rows:
                hi = min(b.num_rows, int(np.searchsorted(upto, before + shard_bytes - size)) + 1)
                held.append(b.slice(lo, hi - lo))
                size += int(upto[hi - 1]) - before
                lo, before = hi, int(upto[hi - 1])
                if size >= shard_bytes:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return run


def _united(count: int):
    """Shards come by range."""

    def run(batches):
        now, held, size = None, [], 0

        def closed():
            w = _often(union(held), count)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([Automaton.build(w).pack()], pa.binary())], ["range", "automaton"])

        for b in batches:
            for r, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if r != now and held:
                    yield closed()
                    held, size = [], 0
                now = r
                held.append(Automaton.unpack(blob.as_buffer()).windows())
                size += len(held[-1].n)
                if size > HELD and len(held) > 1:
                    held = [union(held)]
                    # what is left of a range that is large by itself must grow as much again before the next turn
                    size = min(len(held[0].n), HELD // 2)
        if held:
            yield closed()

    return run


def _bounds(docs: DataFrame, range_words: int) -> list[tuple[str, str, str]]:
    """Where the prefix ranges begin: even steps among prefixes drawn by hash from texts drawn by hash."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(SAMPLE, max(1, size // (6 * range_words)))
    if ranges == 1:
        return []
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_BYTES / size) * (1 << 30)) + 1

    def run(batches):
        for b in batches:
            w = windows(b.column(0), b.column(1))
            own = np.flatnonzero(w.b > 0)
            own = own[np.unique(np.linspace(0, len(own) - 1, min(SAMPLE_BATCH, len(own))).astype(np.int64))] if len(own) else own
            words = w.words
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.langs[i] for i in w.lang[own].tolist()], pa.string()), *[words.take(pa.array(x[own] - 1)).cast(pa.string()) for x in (w.a, w.b)]], ["lang", "one", "two"])

    drawn = batched(docs.where(share).select("lang", "text"), run, "lang string, one string, two string").distinct()
    rows = drawn.orderBy(F.xxhash64("lang", "one", "two"), "lang", "one", "two").limit(SAMPLE).collect()
    rows = sorted(tuple(r) for r in rows)
    return sorted({rows[len(rows) * i // ranges] for i in range(1, ranges)}) if rows else []


_CANDIDATE = "lang string, one string, two string, three string, n long"


def _candidates(count: int):
    """Phrases that occur often enough, and each language's number of words as a row without words."""

    def run(batches):
        for b in batches:
            for blob in b.column("automaton"):
                auto = Automaton.unpack(blob.as_buffer())
                w = auto.windows()
                size = len(w.words) + 1
                pair = (w.lang * size + w.a) * size + w.b
                # the paths of an automaton come by their length, so equal pairs are brought together
                order = np.argsort(pair, kind="stable")
                first = np.flatnonzero(np.diff(pair[order], prepend=-1))
                total = np.add.reduceat(w.n[order], first) if len(first) else first
                two = order[first]
                fine = (w.b[two] > 0) & (total >= count)
                two, n2 = two[fine], total[fine]
                three = np.flatnonzero((w.c > 0) & (w.n >= count))
                at = np.concatenate([two, three])
                word = lambda x: w.words.take(pa.array(x, mask=x < 0)).cast(pa.string())
                third = np.concatenate([np.full(len(two), -1), w.c[three] - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w.langs[i] for i in w.lang[at].tolist()], pa.string()), word(w.a[at] - 1), word(w.b[at] - 1), word(third), pa.array(np.concatenate([n2, w.n[three]]), pa.int64())],
                    ["lang", "one", "two", "three", "n"])
                none = pa.nulls(len(auto.lang[0]), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([w.langs[i] for i in auto.lang[0].tolist()], pa.string()), none, none, none, pa.array(auto.lang[1])], ["lang", "one", "two", "three", "n"])

    return run


def _sent(bounds: list[tuple[str, str, str]]):
    """Parts to the ranges that hold their beginnings: a pair of words lies in one, a single word in one or in several."""

    def run(batches):
        for b in batches:
            out = []
            for lang, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one, _, two = part.partition(" ")
                lo = bisect_right(bounds, (lang, one, two))
                hi = lo if two else bisect_left(bounds, (lang, one + "\0", ""))
                out += [(r, lang, one, two or None) for r in range(lo, hi + 1)]
            ranges, langs, ones, twos = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(langs, pa.string()), pa.array(ones, pa.string()), pa.array(twos, pa.string())], ["range", "lang", "one", "two"])

    return run


def _answers(batches):
    """The automaton of a range comes first, then the parts it is asked for."""
    now = auto = None
    for b in batches:
        ranges = b.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [len(ranges)]])
        for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
            if ranges[lo] != now:
                now, auto = ranges[lo], None
            part = b.slice(lo, hi - lo)
            blobs = part.column(4)
            if blobs[0].is_valid:
                auto, part = Automaton.unpack(blobs[0].as_buffer()), part.slice(1)
            if not part.num_rows or auto is None:
                continue
            langs, one, two = (part.column(k).to_pylist() for k in (1, 2, 3))
            n = auto.weights(langs, one, two)
            phrase = [x if y is None else f"{x} {y}" for x, y in zip(one, two)]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrase, pa.string()), pa.array(n, pa.int64())], ["lang", "part", "n"])


def _weights(automata: DataFrame, parts: DataFrame, bounds: list) -> DataFrame:
    """(lang, part, n) for distinct ``parts(lang, part)``."""
    asked = batched(parts, _sent(bounds), "range long, lang string, one string, two string").withColumn("automaton", F.lit(None).cast("binary"))
    none = F.lit(None).cast("string")
    held = automata.select("range", none.alias("lang"), none.alias("one"), none.alias("two"), "automaton")
    rows = held.unionByName(asked).repartition(max(1, len(bounds) + 1), "range").sortWithinPartitions("range", F.col("automaton").isNull())
    return batched(rows, _answers, "lang string, part string, n long").groupBy("lang", "part").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, count: int = COUNT, covered: int = COVERED, top: int = TOP, shard_bytes: int = SHARD_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of every language of ``docs(lang, text)``.

    Nulls: a null text is an empty one; texts without a language are those of ``und``. Repeated rows count as often. Equal
    scores go by more occurrences, then by the phrase. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"))
    bounds = _bounds(docs, range_words)
    shards = batched(docs, _shards(bounds, shard_bytes), "range long, automaton binary")
    dealt = shards.repartition(len(bounds) + 1, "range").sortWithinPartitions("range")
    automata = stored(batched(dealt, _united(count), "range long, automaton binary"), "automata")
    found = stored(batched(automata, _candidates(count), _CANDIDATE), "candidates")
    words = found.where("one IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = found.where("one IS NOT NULL").select("lang", "one", "two", "three", F.concat_ws(" ", "one", "two", "three").alias("phrase"), F.col("n").alias("a"))
    # a phrase of two words goes where a longer one takes most of its occurrences
    pair = lambda x, y: F.concat_ws(" ", x, y)
    longer = phrases.where("three IS NOT NULL").select("lang", F.explode(F.array(pair("one", "two"), pair("two", "three"))).alias("phrase"), F.col("a").alias("longest"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    left = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | F.col("three").isNotNull() | (F.lit(100) * F.col("longest") < F.lit(covered) * F.col("a")))
    cut = lambda k, x, y: F.struct(F.lit(k).alias("k"), x.alias("first"), y.alias("rest"))
    one, two, three = F.col("one"), F.col("two"), F.col("three")
    ways = F.when(three.isNull(), F.array(cut(1, one, two))).otherwise(F.array(cut(1, one, pair(two, three)), cut(2, pair(one, two), three)))
    cuts = stored(left.select("lang", "phrase", "a", F.explode(ways).alias("w")).select("lang", "phrase", "a", "w.*"), "cuts")
    parts = cuts.select("lang", F.explode(F.array("first", "rest")).alias("part")).distinct()
    weights = stored(_weights(automata, parts, bounds), "weights")
    full = cuts.join(weights.select("lang", F.col("part").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    full = full.join(weights.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    # decimals hold the products exactly
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    full = full.select("lang", "phrase", "a", "k", "l", "r", (wide("a") * wide("a")).alias("aa"), (wide("l") * wide("r")).alias("lr"))
    scored = full.withColumn("score", F.expr(f"CAST(aa * CAST({SCALE} AS DECIMAL(7,0)) AS DECIMAL(38,0)) div CAST(lr AS DECIMAL(38,0))"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w")).select("lang", "phrase", "a", "w.score", "w.l", "w.r")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the best of a part of a language first, so that no task sorts all phrases of one
    some = Window.partitionBy("lang", "part").orderBy(*order)
    few = worst.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    long = [F.col(x).cast("long").alias(x) for x in ("a", "l", "r", "n", "score")]
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *long)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of every language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0a-\x0d]')) AS piece FROM documents
), line AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece
), gram AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM line, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM gram GROUP BY ALL
), total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), candidate AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {COUNT}
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidate WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidate c LEFT JOIN longer USING (lang, phrase) WHERE c.k = 3 OR longer.a IS NULL OR 100 * longer.a < {COVERED} * c.a
), cut AS (SELECT *, unnest(range(1, k)) AS j FROM kept
), scored AS (
  SELECT cut.lang, cut.phrase, a, x.n AS l, y.n AS r, j, CAST({SCALE}::HUGEINT * a * a // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1 : j], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[j + 1 : cut.k], ' ')
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
