import random
import zlib

import numpy as np
import pytest
from fixtures import docs, empty, words

from plumbline.llm import langid


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 60, k), k) for i, k in enumerate(["en", "de", "fr"] * 30)]
    return langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    given = [(i, words(rng, 40, k), k, "s", 1) for i, k in enumerate(["en", "de", "fr"] * 40)]
    found = {r["doc_id"]: r for r in langid.identify(spark, spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in given)
    assert all(found[i]["lang_pred"] == k for i, _, k, *_ in given if found[i]["held_out"])


def test_counts_are_those_of_the_learning_rows(spark, model):
    cell, begins, of = langid._trigrams(["Ab cé", "", "x"])
    assert len(cell) == 6 and begins.tolist() == [0, 2, 5] and of.tolist() == [0, 0, 2]
    assert model.names == ["de", "en", "fr"] and np.allclose(np.exp(model.logs.astype(float)).sum(axis=0), 1)


def test_mixture_shares(model):
    rng = random.Random(3)
    text = words(rng, 300, "en") + " " + words(rng, 100, "fr")
    best, share = model.mixtures([text, words(rng, 50, "de"), ""])
    assert model.names[best[0]] == "en" and abs(share[0] - 0.75) < 0.05
    assert model.names[best[1]] == "de" and share[1] == 1.0 and share[2] == 0.0


def test_blocks_do_not_change_results(model, monkeypatch):
    rng = random.Random(4)
    texts = [words(rng, rng.randint(0, 50), k) for k in ["en", "de", "fr"] * 10]
    whole = model.mixtures(texts)
    monkeypatch.setattr(langid, "BLOCK", 50)
    parts = model.mixtures(texts)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_awkward_rows(spark):
    table = docs(spark)
    out = langid.identify(spark, table)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = out.collect()
    assert len(found) == table.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert {by_id[i]["lang_pred"] for i in (110, 111, 112, 113)} == {"und"} and by_id[120]["lang_pred"] == "de"
    kept = langid.keep_known(spark, table, "")
    assert kept.columns == table.columns and {110, 111, 112, 113}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_empty_and_unlabelled(spark):
    assert langid.identify(spark, empty(spark)).count() == 0
    plain = spark.createDataFrame([(1, "some words", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [tuple(r)[2:] for r in langid.identify(spark, plain).collect()] == [("und", 0.0)]
