"""Both vector searches against brute force."""

import numpy as np
import pytest

from plumbline.llm import rpforest, vafile
from plumbline.llm.vectors import valid

SCHEMA = "vec_id long, embedding array<float>, v string, id string, first int"


def awkward(spark, n=600, dim=8):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[200:400] = x[0]  # a third of all rows are one vector
    rows = [(i, v.tolist(), "v", "i", 1) for i, v in enumerate(x)]
    rows += [(n, None, "", "", 0), (n + 10, [0.0] * dim, "", "", 0), (n + 20, [float("nan")] + [0.5] * (dim - 1), "", "", 0), (n + 30, [float("inf")] + [0.5] * (dim - 1), "", "", 0)]
    rows += [(n + 40, [None] + [0.5] * (dim - 1), "", "", 0), (None, [0.5] * dim, "", "", 0), (n + 50, [], "", "", 0), rows[0], rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), x


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        score = x @ x[list(ids).index(q)]
        order = sorted((-s, i) for s, i in zip(score.tolist(), ids) if i != q)[:k]
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(order)]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("wave, held", [(7, 2_000_000), (4096, 10)])
def test_exact_search(spark, monkeypatch, wave, held):
    from pyspark.sql import functions as F

    monkeypatch.setattr(vafile, "HELD", held)

    table, x = awkward(spark)
    rows = valid(table, "vec_id", "embedding").select("id", F.transform("v", lambda c: F.floor(c * 256).cast("long")).alias("v"))
    whole = np.floor(256 * x.astype(np.float64))
    ids = [*range(600), 610]
    whole = np.vstack([whole, np.zeros(8)])
    queries = [i for i in ids if i % 10 == 0]
    found = vafile.search(rows, rows.where(F.col("id") % 10 == 0), 5, wave)
    assert grouped(found) == {q: [(r, i, int(s)) for r, i, s in v] for q, v in brute(ids, whole, queries, 5).items()}


def test_few_rows_give_all(spark):
    rows = spark.createDataFrame([(1, [3, -4]), (2, [1, 1]), (3, [1, 1])], "id long, v array<long>")
    assert grouped(vafile.search(rows, rows, 5)) == {1: [(1, 2, -1), (2, 3, -1)], 2: [(1, 3, 2), (2, 1, -1)], 3: [(1, 2, 2), (2, 1, -1)]}
    assert vafile.search(rows.limit(0), rows.limit(0)).count() == 0
    assert rpforest.search(rows.limit(0), rows.limit(0)).count() == 0
    one = spark.createDataFrame([(4, [1.0, 2.0])], "id long, v array<double>")
    assert rpforest.search(one, one).count() == 0


@pytest.mark.parametrize("part", [10, 2_000, 8 << 20])
def test_forest_search(spark, monkeypatch, part):
    from pyspark.sql import functions as F

    monkeypatch.setattr(rpforest, "PART_BYTES", part)

    table, x = awkward(spark)
    rows = valid(table, "vec_id", "embedding", nonzero=True)
    x = x.astype(np.float64)
    queries = range(0, 600, 20)
    want = brute(range(600), x, queries, 20)
    found = grouped(rpforest.search(rows, rows.where(F.col("id") % 20 == 0)))
    assert set(found) == set(queries) and all(len(v) == 20 for v in found.values())
    recall = np.mean([len({i for _, i, _ in found[q]} & {i for _, i, _ in want[q]}) / 20 for q in queries])
    assert recall >= 0.9
    for q, v in found.items():
        assert [r for r, _, _ in v] == list(range(1, 21)) and q not in {i for _, i, _ in v}
        assert all(abs(s - x[q] @ x[i]) < 1e-12 for _, i, s in v)
        assert [(-s, i) for _, i, s in v] == sorted((-s, i) for _, i, s in v)
        # the shared vector's copies come by id
        copies = [i for _, i, _ in v if i == 0 or 200 <= i < 400]
        assert copies == [i for i in [0, *range(200, 400)] if i != q][: len(copies)]


def shapes(n, dim, rng):
    """Vectors spread evenly, of unlike length, in clusters, and in a few dimensions."""
    even = rng.normal(size=(n, dim))
    clusters = rng.normal(size=(n // 100, dim))[rng.integers(0, n // 100, n)] + 0.2 * rng.normal(size=(n, dim))
    few = rng.normal(size=(n, 5)) @ rng.normal(size=(5, dim)) + 0.05 * rng.normal(size=(n, dim))
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (even, clusters, few)]
    return {"even": unit[0], "unlike": even * rng.lognormal(0, 0.5, (n, 1)), "clusters": unit[1], "few": unit[2]}


@pytest.mark.parametrize("shape, most", [("even", 1.0), ("unlike", 1.0), ("clusters", 0.1), ("few", 0.2)])
def test_recall_whatever_the_lengths_and_less_work_where_there_is_structure(spark, monkeypatch, shape, most):
    n, dim = 6000, 32
    x = shapes(n, dim, np.random.default_rng(11))[shape]
    monkeypatch.setattr(rpforest, "PART_BYTES", 100_000)
    opened = []
    learn = rpforest.Forest.learn

    def watch(forest, recall, asked):
        learn(forest, recall, asked)
        places, queries = rpforest.lifted(x, forest.longest2), x[:200]
        seen = np.zeros((200, n), bool)
        for tree in forest.trees:
            seen |= (tree.far(rpforest.asking(queries)) <= forest.limits(queries)[:, None])[:, tree.leaf_of(places)]
        opened.append(seen.mean())

    monkeypatch.setattr(rpforest.Forest, "learn", watch)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    queries = range(0, n, 60)
    # learned on a third of the vectors, so that the sample still holds 20 of a cluster: beyond that a query looks further than it must
    found = grouped(rpforest.search(rows, rows.where("id % 60 = 0"), sample=2000))
    want = brute(range(n), x, queries, 20)
    recall = np.mean([len({i for _, i, _ in found[q]} & {i for _, i, _ in want[q]}) / 20 for q in queries])
    assert set(found) == set(queries) and recall >= 0.9
    assert opened[0] <= most


def test_leaves_open_in_order_of_the_queue():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(3000, 6))
    trees = [rpforest.grow(sample, rng) for _ in range(3)]
    for t in trees:
        assert np.bincount(t.leaf_of(sample), minlength=t.leaves).max() <= rpforest.LEAF
    for q in rng.normal(size=(20, 6)):
        opened = rpforest.open_leaves(trees, q, np.inf)
        assert len(opened) == len(set(opened)) == sum(t.leaves for t in trees)
        far = [t.far(q[None])[0] for t in trees]
        order = [far[i][leaf] for i, leaf in opened]
        assert order == sorted(order) and order[:3] == [0.0] * 3
        assert all((i, int(t.leaf_of(q[None])[0])) in opened[:3] for i, t in enumerate(trees))
        some = rpforest.open_leaves(trees, q, 0.3)
        assert some == opened[: len(some)] and len(some) == sum((f <= 0.3).sum() for f in far)
        # a bound of the distance of all that a leaf holds
        for t, f in zip(trees, far):
            assert (np.linalg.norm(sample - q, axis=1) >= f[t.leaf_of(sample)] - 1e-12).all()


def test_strays_do_not_decide_the_dimension(spark):
    given = [(i, [float(i), 1.0, 2.0]) for i in range(5)] + [(5, [1.0, 2.0, 3.0, 4.0]), (6, [1.0, 2.0]), (7, [9.0] * 5), (8, None)]
    rows = spark.createDataFrame(given, "vec_id long, embedding array<float>")
    for nonzero in (False, True):
        assert sorted(r["id"] for r in valid(rows, "vec_id", "embedding", nonzero).collect()) == [0, 1, 2, 3, 4]


def test_ids_with_several_vectors(spark):
    """A query id with two vectors, and an id whose vectors would take all places, leave k others."""
    rng = np.random.default_rng(7)
    given = [(i, rng.integers(-200, 200, 4).tolist()) for i in range(2, 60)]
    given += [(1, [900, 900, 0, 0]), (1, [900, -900, 0, 0])] + [(50, [800 + i, 0, 0, 0]) for i in range(12)]
    want = {}
    for q in (1, 2, 50):
        score = {}
        for i, v in given:
            if i != q:
                score[i] = max([score.get(i, -1 << 60)] + [int(np.dot(a, v)) for j, a in given if j == q])
        want[q] = [(r + 1, i, s) for r, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5])]
    rows = spark.createDataFrame(given, "id long, v array<long>")
    for wave in (1, 4096):
        assert grouped(vafile.search(rows, rows.where("id IN (1, 2, 50)"), 5, wave)) == want
    doubles = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in given], "id long, v array<double>")
    assert grouped(rpforest.search(doubles, doubles.where("id IN (1, 2, 50)"), 5)) == want
