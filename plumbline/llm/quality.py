"""Quality of whole texts by a generalised additive model with pairwise interactions.

A text is some numbers counted over all of it. Each is cut into bins at quantiles; the model is a table over
the bins of every feature and, for some pairs of features, a table over pairs of bins. The tables are
learned by cyclic boosting: round after round, a shallow tree is fitted to the log-loss gradients of one
feature at a time and a small part of it is added to that feature's table. Then the pairs whose coarse
grids explain most of what is left get tables of their own, in the same way. A score is the
sum of one number a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from plumbline.llm.common import batched, small_batches, table
from plumbline.llm.langid import crc_mod
from plumbline.runtime import ship

#: Labelled texts to learn from (all, if fewer). They are drawn by a hash of their id.
LEARN_TEXTS = 12_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIRS = 8
PAIR_ROUNDS = 60
RATE = 0.1
#: Smallest sum of second derivatives of a leaf, and what is added to it.
LEAF_WEIGHT = 2.0
RIDGE = 1.0
CUT = 0.3

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "long_words", "distinct_words", "digits", "upper", "signs", "commas_stops", "blank", "high_bytes",
    "log_lines", "line_bytes", "distinct_lines", "short_lines", "top_word", "words_end_sign", "words_upper", "words_no_letter", "stops_per_word",
    "top_sign", "braces", "line_end_stops", "distinct_pairs",
]

_DIGIT, _UPPER, _LOWER = (np.array(list(x), np.uint8) for x in (b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_BLANK, _STOPS, _BRACES = (np.array(list(x), np.uint8) for x in (b" \t\n\r\x0b\x0c", b".,;:!?", b"<>{}[]()|\\/=_"))
_SIGNS = np.array([c for c in range(33, 127) if not chr(c).isalnum()], np.uint8)
_STRANGE = np.setdiff1d(_SIGNS, _STOPS)
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 letter or high byte, 3 sign
_KIND[_LOWER], _KIND[128:], _KIND[_UPPER], _KIND[_SIGNS] = 2, 2, 1, 3


def features(text: bytes | None) -> list[float]:
    """The numbers of FEATURES for one text; all are 0 for one without words."""
    words = (text or b"").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text, np.uint8)
    n, n_words = len(raw), len(words)
    counts = np.bincount(raw, minlength=256)
    part = lambda c: float(counts[c].sum()) / n
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    joined = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths)
    kind = _KIND[joined]
    upper = np.add.reduceat(kind == 1, ends - lengths, dtype=np.int64)
    letters = upper + np.add.reduceat(kind == 2, ends - lengths, dtype=np.int64)
    often: dict[bytes, int] = {}
    for w in words:
        often[w] = often.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    n_lines = max(1, len(lines))
    stops = counts[_STOPS].sum()
    last = joined[ends - 1]
    return [
        np.log1p(n), np.log1p(n_words), float(lengths.mean()), float((lengths > 12).mean()), len(often) / n_words, part(_DIGIT), part(_UPPER), part(_STRANGE), float(stops) / n, part(_BLANK),
        float(counts[128:].sum()) / n, np.log1p(n_lines), np.log1p(n / n_lines), len(set(lines)) / n_lines, sum(len(x) < 30 for x in lines) / n_lines, max(often.values()) / n_words,
        float(np.isin(last, _STRANGE).mean()), float(((upper > 1) & (upper == letters)).mean()), float((letters == 0).mean()), float(stops) / n_words,
        float(counts[_STRANGE].max()) / n_words, part(_BRACES), sum(x[-1:] in b".!?" for x in lines) / n_lines, len(set(zip(words, words[1:]))) / max(1, n_words - 1),
    ]


def matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t) for t in texts.cast(pa.binary()).to_pylist()], np.float64).reshape(len(texts), len(FEATURES))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values along the bins of one feature, of a tree that halves the bins ``depth`` times at the best place."""
    out = np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= LEAF_WEIGHT) & (hr >= LEAF_WEIGHT), gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE), -1.0)
        at = int(gain.argmax()) + 1
        if gain[at - 1] > g.sum() ** 2 / (h.sum() + RIDGE) + 1e-9:
            out[:at], out[at:] = _leaves(g[:at], h[:at], depth - 1), _leaves(g[at:], h[at:], depth - 1)
    return out


def _grid(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values over a grid of bins, of a tree with one cut along one side and one along the other in each half; and its gain."""
    best, base = (np.full(g.shape, -g.sum() / (h.sum() + RIDGE)), 0.0), g.sum() ** 2 / (h.sum() + RIDGE)
    for turn in (0, 1):
        a, b = (g, h) if not turn else (g.T, h.T)
        for at in range(1, len(a)):
            out, gain = np.empty(a.shape), -base
            for part in (slice(None, at), slice(at, None)):
                gs, hs = a[part].sum(axis=0), b[part].sum(axis=0)
                values = _leaves(gs, hs, 1)
                out[part] = values
                for v in np.unique(values):
                    mine = values == v
                    gain += gs[mine].sum() ** 2 / (hs[mine].sum() + RIDGE)
            if gain > best[1] + 1e-12:
                best = (out if not turn else out.T.copy(), gain)
    return best


@dataclass
class Additive:
    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for (i, j), t in zip(self.pairs, self.grids):
            out += t[_coarse(bins[:, i]), _coarse(bins[:, j])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _coarse(bins: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // BINS


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Learn from numbers and labels 0 or 1. Without rows every score is 0.5; with one label, near that label."""
    model = Additive()
    if not len(y):
        return model
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    bins = model.bins(x)
    model.tables = [np.zeros(BINS) for _ in model.cuts]
    f = np.full(len(y), model.base)

    def gradients():
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(bins.shape[1]):
            g, h = gradients()
            step = RATE * _leaves(np.bincount(bins[:, j], g, BINS), np.bincount(bins[:, j], h, BINS), 2)
            model.tables[j] += step
            f += step[bins[:, j]]
    coarse = _coarse(bins)
    cell = lambda i, j: coarse[:, i] * PAIR_BINS + coarse[:, j]
    on_grid = lambda i, j, w: np.bincount(cell(i, j), w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = gradients()
    gains = {(i, j): _grid(on_grid(i, j, g), on_grid(i, j, h))[1] for i, j in combinations(range(bins.shape[1]), 2)}
    model.pairs = sorted(sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS])
    model.grids = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = gradients()
            step = RATE * _grid(on_grid(i, j, g), on_grid(i, j, h))[0]
            model.grids[k] += step
            f += step.ravel()[cell(i, j)]
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARN_TEXTS) -> Additive:
    """Fit on about ``most`` labelled texts at most. The driver gets their numbers, not their texts."""
    labelled = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("int").alias("y"))
    labelled = labelled.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (crc_mod(F.col("id"), 5) != 0))
    n = labelled.count()
    draw = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30)) < F.lit(int(min(1.0, most / max(n, 1)) * (1 << 30)))
    taken = labelled.where(draw)

    def run(batches):
        for b in batches:
            rows = pa.array(matrix(b.column(2)).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows], ["id", "y", "x"])

    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text"))
    joined = texts.join(F.broadcast(taken), "id").select("id", "y", "text")  # at most about ``most`` rows
    found = batched(joined, run, "id long, y int, x array<double>").toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array(found["x"].to_pylist()), found["y"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y, found["id"].to_numpy()))
    return fit(x[order], y[order])


def predict(spark: SparkSession, model: Additive, text: Column) -> Column:
    """The score of a column of texts; a null text is an empty one."""
    ship(spark)
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(matrix(pc.fill_null(texts, ""))), pa.float64())

    return score(text)


def grade(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Nulls: a null text is an empty one; labels without doc_id or quality are not learned from; a null doc_id has
    held_out false. Repeated rows are scored alike. Empty tables give no rows, or the score 0.5 without labels.
    """
    found = docs.select(docs["doc_id"].alias("doc_id"), predict(spark, learn(docs, labels), docs["text"]).alias("score"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    return grade(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted to be of quality stay, with all their columns."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(predict(spark, model, docs["text"]) >= CUT)
