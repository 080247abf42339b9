import random
import re
from collections import Counter, defaultdict

import pytest
from fixtures import docs, empty, rows

from plumbline.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights, share, most):
    """Water filling by hand: cap whatever is above its limit and share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        above = [s for s in free if rest * weight[s] / w > most * sizes[s] + 1e-9]
        if not above:
            return fixed | {s: rest * weight[s] / w for s in free}
        fixed |= {s: most * sizes[s] for s in above}


def test_pivot_keeps_the_sum_and_the_means():
    rng = random.Random(0)
    words = [rng.randint(1, 100) for _ in range(40)]
    p = [0.3] * 40
    taken = [0.0] * 40
    for trial in range(600):
        out = mixing.pivot(p, words, [trial * 1000 + i for i in range(40)])
        assert abs(sum(a * w for a, w in zip(out, words)) - 0.3 * sum(words)) < 1e-6
        assert sum(0 < x < 1 for x in out) <= 1
        taken = [a + b for a, b in zip(taken, out)]
    assert all(abs(t / 600 - 0.3) < 0.09 for t in taken)
    last = mixing.pivot(p, words, list(range(40)), last=True)
    assert set(last) <= {0.0, 1.0} and abs(sum(a * w for a, w in zip(last, words)) - 0.3 * sum(words)) <= max(words)


@pytest.mark.parametrize("bucket", [5, 1000])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "FAN", 3)
    table = docs(spark, 200)
    given = table.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in given:
        sizes[r["source"]] += size(r["text"])
    want = targets(dict(sizes), mixing.WEIGHTS, mixing.SHARE, mixing.MOST_COPIES)
    found = mixing.mix(table).collect()
    assert sorted((repr(r["doc_id"]), r["size"]) for r in found) == sorted((repr(r["doc_id"]), size(r["text"])) for r in given)
    words = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 2
        words[r["source"]] += r["copies"] * r["size"]
    for s, t in want.items():
        # the 30,000 words of one text outweigh all others of its source; no choice of whole copies comes nearer than that
        assert abs(words[s] - t) <= (30_000 if s == "s3" else 40), (s, words[s], t)
    again = mixing.mix(table.repartition(3)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_repeating_rows(spark):
    table = docs(spark)
    copies = Counter()
    for r in mixing.mix(table).collect():
        copies[r["doc_id"], r["key"]] += r["copies"]
    out = mixing.repeat_to_weights(spark, table, "")
    assert out.columns == table.columns
    from pyspark.sql import functions as F

    got = Counter((r[0], r[1]) for r in out.select("doc_id", F.xxhash64("doc_id", "text")).collect())
    assert got == Counter({k: v for k, v in copies.items() if v})


def test_equal_rows_are_one_entry(spark, monkeypatch):
    """A third of the rows are one row: nobody holds them together, and their words come out as aimed at."""
    monkeypatch.setattr(mixing, "PART", 100)
    hot = spark.range(3_000).selectExpr("1L AS doc_id", "'one two three' AS text", "'a' AS source")
    rest = spark.range(6_000).selectExpr("id + 10 AS doc_id", "repeat('w ', 1 + id % 20) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    table = hot.unionByName(rest)
    assert mixing.entries(table).count() == 6_001
    found = mixing.mix(table).collect()
    assert Counter(r["doc_id"] for r in found) == Counter({1: 3_000} | {i + 10: 1 for i in range(6_000)})
    words = defaultdict(int)
    for r in found:
        words[r["source"], r["target"]] += r["copies"] * r["size"]
    assert len(words) == 2 and all(abs(n - target) <= 20 for (_, target), n in words.items())
    copies = [r["copies"] for r in found if r["doc_id"] == 1]
    target, size = next((r["target"], r["source_size"]) for r in found if r["doc_id"] == 1)
    assert abs(sum(copies) - 3_000 * target / size) < 1 and max(copies) - min(copies) <= 1
    assert sorted(found) == sorted(mixing.mix(table.repartition(7)).collect())


def test_empty_and_wordless(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.repeat_to_weights(spark, empty(spark), "").count() == 0
    table = spark.createDataFrame([(1, None, "en", "s", 0), (2, " ", "en", None, 0)], empty(spark).schema)
    assert [(r["size"], r["target"]) for r in mixing.mix(table).collect()] == [(0, 0.0)] * 2
    assert rows(mixing.mix(table).select("doc_id")) == [(1,), (2,)]
