"""Language of whole texts as a mixture, inferred by expectation-maximisation.

A language is a distribution of byte trigrams of words, learned from labelled texts. A text's words are
drawn from several languages in unknown proportions. Expectation-maximisation estimates them: a word's
likelihood in each language is that of its trigrams, words are shared out by proportion times
likelihood, and the shares are the next proportions. The languages of a text are chosen by penalised
likelihood: of the sets of its s strongest languages, s = 1, 2, ..., the one with the
largest log-likelihood less half a logarithm of the number of words (times ``PENALTY``) a language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from plumbline.llm.common import batched, small_batches, table
from plumbline.runtime import ship

#: Labelled texts to learn a language from (all, if fewer). They are drawn by a hash of their id.
LEARN_TEXTS = 4_000
#: Cells that trigrams are hashed to. A model has this many numbers a language.
CELLS = 1 << 16
#: More languages than this are refused; the model would not fit a worker.
MOST_LANGUAGES = 1_000
#: Strongest languages that a text's set is chosen from.
MOST_MIXED = 3
STEPS = 8
PENALTY = 4.0
SMOOTH = 0.5
#: A document whose main language has less than this share is rejected by the pipeline.
MAIN_SHARE = 0.4
#: Bytes worked on together.
BLOCK = 1 << 21

_SEPARATES = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = r"\p{L}"


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of the trigram around every letter byte; where each word begins among them; the text of each word."""
    parts = [t.lower().encode("utf-8", "replace").translate(_SEPARATES) for t in texts]
    joined = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    text_of = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
    at = np.flatnonzero(joined[1:-1] != 32) + 1
    code = (joined[at - 1].astype(np.uint32) << 16) | (joined[at].astype(np.uint32) << 8) | joined[at + 1]
    cell = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    begins = np.flatnonzero(joined[at - 1] == 32)
    return cell, begins, text_of[at[begins] - 1]


def _blocks(texts: list[str]):
    """Runs of texts of about BLOCK characters; a longer text is a run of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  # cells x languages

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Strongest language and its share of every text. A text without words has share 0."""
        best, share = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for lo, hi in _blocks(texts):
            cell, begins, of = _trigrams(texts[lo:hi])
            if len(begins):
                logs = np.add.reduceat(self.logs[cell], begins, axis=0).astype(np.float64)
                which, size = np.unique(of, return_counts=True)
                best[lo + which], share[lo + which] = self._infer(logs, size)
        return best, share

    def _infer(self, logs: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), size)
        top = logs.max(axis=1)
        like = np.exp(logs - top[:, None])
        base = np.add.reduceat(top, begins)
        n_lang = logs.shape[1]

        def climb(allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
            pi = allowed / allowed.sum(axis=1, keepdims=True)
            for _ in range(steps):
                part = like * pi[of]
                part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
                pi = np.add.reduceat(part, begins, axis=0) / size[:, None]
            fit = np.add.reduceat(np.log(np.maximum((like * pi[of]).sum(axis=1), 1e-300)), begins) + base
            return pi, fit

        pi, _ = climb(np.ones((len(size), n_lang)), STEPS)
        alone = np.add.reduceat(logs, begins, axis=0)
        # the best single language leads, the others follow by share
        rank = np.argsort(-(pi + 2.0 * (np.arange(n_lang) == alone.argmax(axis=1)[:, None])), axis=1, kind="stable")
        best, share = rank[:, 0].copy(), np.ones(len(size))
        value = alone[np.arange(len(size)), best]
        cost = PENALTY * 0.5 * np.log(size + 1.0)
        for s in range(2, min(MOST_MIXED, n_lang) + 1):
            allowed = np.zeros((len(size), n_lang))
            np.put_along_axis(allowed, rank[:, :s], 1.0, axis=1)
            mixed, fit = climb(allowed, STEPS)
            fit = fit - (s - 1) * cost
            better = fit > value
            value = np.where(better, fit, value)
            best = np.where(better, mixed.argmax(axis=1), best)
            share = np.where(better, mixed.max(axis=1), share)
        return best, share


def _count(batches):
    for b in batches:
        lang = b.column(0).dictionary_encode()
        for k, name in enumerate(lang.dictionary.to_pylist()):
            texts = b.column(1).filter(pc.equal(lang.indices, k)).to_pylist()
            counts = np.zeros(CELLS, np.int64)
            for lo, hi in _blocks(texts):
                counts += np.bincount(_trigrams(texts[lo:hi])[0], minlength=CELLS)
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(seen), "cell": seen.astype(np.int32), "n": counts[seen]}, schema=_COUNTS)


_COUNTS = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])


def learn(labelled: DataFrame, most: int = LEARN_TEXTS) -> Languages:
    """Trigram distributions from rows of (doc_id, text, lang), at most about ``most`` rows a language.

    The counts are added up by Spark; cells x languages numbers come to the driver.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values of lang")
    names = sorted(sizes)
    if not names:
        return Languages([], np.zeros((CELLS, 0), np.float32))
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(most / sizes[name])) for name in names])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = labelled.where(draw < share).select("lang", "text")
    found = batched(taken, _count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((CELLS, len(names)))
    place = {n: i for i, n in enumerate(names)}
    counts[found["cell"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    counts += SMOOTH
    return Languages(names, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def predict(spark: SparkSession, model: Languages, text: Column) -> Column:
    """A column of (lang_pred, score): the language with the largest share, and that share; ``und`` and 0 for a
    text that is null or has no letter, or if no language was learned."""
    ship(spark)
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @arrow_udf("struct<lang_pred: string, score: double>")
    def infer(texts: pa.Array) -> pa.Array:
        m = sent.value
        known = pc.fill_null(pc.match_substring_regex(texts, _LETTER), False).to_numpy(zero_copy_only=False)
        values = pc.fill_null(texts, "").to_pylist()
        best, share = m.mixtures([t if k else "" for t, k in zip(values, known)]) if m.names else (None, np.zeros(len(values)))
        names = [m.names[best[i]] if share[i] > 0 else "und" for i in range(len(values))]
        return pa.array([{"lang_pred": a, "score": float(min(b, 1.0))} for a, b in zip(names, share)], kind)

    return infer(text)


def _learned(docs: DataFrame) -> Languages:
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    return learn(rows.where(crc_mod(rows["doc_id"], 4) != 2))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Nulls: a null text is ``und``; a row with a null lang is predicted but not learned from; a null doc_id has
    held_out false and is not learned from. Repeated rows are predicted alike, and learned from as often. An empty
    table gives no rows.
    """
    found = docs.select(docs["doc_id"].alias("doc_id"), predict(spark, _learned(docs), docs["text"]).alias("p"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "p.lang_pred", "p.score")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents."""
    return identify(spark, table(spark, sf_dir, "documents"))


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a main language stay, with all their columns; without a letter or a main language they go."""
    p = predict(spark, _learned(docs), docs["text"])
    return docs.where((p["lang_pred"] != "und") & (p["score"] >= MAIN_SHARE))
