import random
import zlib

import numpy as np
from fixtures import docs, empty, words

from plumbline.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=400):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = words(rng, 80) + "." if good else rng.choice([" | ".join(words(rng, 60).split()), words(rng, 60).upper().replace(" ", "!! "), words(rng, 60).replace(" ", "*** ")])
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), labels


def test_held_out_quality(spark):
    table, labels = corpus(spark)
    found = quality.grade(spark, table, spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0), (9999, 1, 0)], LABELS)).collect()
    truth = {d: q for d, q, _ in labels}
    assert len(found) == 400
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_tables_add_up_to_the_raw_score():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(800) < 0.05)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs  # found without any main effect
    assert np.mean((model.score(x) > 0.5) == y) > 0.85
    bins = model.bins(x)
    by_hand = [model.base + sum(t[b] for t, b in zip(model.tables, row)) + sum(g[row[i] * 8 // 32, row[j] * 8 // 32] for (i, j), g in zip(model.pairs, model.grids)) for row in bins]
    assert np.allclose(by_hand, model.raw(x))


def test_features_of_odd_texts():
    for text in (None, b"", b" \n", b"a", b"\xff\xfe x", b"a" * 100_000, b"x " * 50_000):
        got = quality.features(text)
        assert len(got) == len(quality.FEATURES) and np.isfinite(got).all()


def test_awkward_rows(spark):
    table = docs(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS)
    found = quality.grade(spark, table, labels).collect()
    assert len(found) == table.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
    none = quality.grade(spark, table, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.grade(spark, empty(spark), labels).count() == 0
    one = quality.grade(spark, table, spark.createDataFrame([(i, 1, 0) for i in range(60)], LABELS)).collect()
    assert min(r["score"] for r in one) > 0.9
