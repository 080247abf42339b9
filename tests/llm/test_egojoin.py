"""The grid order join against all pairs."""

import numpy as np
import pytest

from plumbline.llm import egojoin

SCHEMA = "vec_id long, embedding array<double>, v string, id string, cls int, no int"


def brute(rows, cosine=0.95):
    """One row a row, in order: id, links, component, kept."""
    fine = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = {i: set() for i in range(len(rows))}
    for i in fine:
        for j in fine:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    link[i].add(j), link[j].add(i)
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            more = link[todo.pop()] - seen
            seen |= more
            todo += more
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((name, len(link[i]), least, name == least))
    return sorted(out, key=repr)


def cloud(n=260, dim=12, seed=1):
    """Scattered vectors of unlike length, a chain of neighbours, a crowd of near copies and a third of exact ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.1, 30, size=(n, 1))
    turn = np.linspace(0, 2.5, 40)
    x[:40] = 0
    x[:40, 0], x[:40, 1] = np.cos(turn), np.sin(turn)
    x[40:90] = x[200] + 0.05 * np.linalg.norm(x[200]) * rng.normal(size=(50, dim)) / np.sqrt(dim)
    x[90:170] = x[90]
    x[170] = 2 * x[90]
    return x


def rows_of(x):
    return [(i, v.tolist()) for i, v in enumerate(x)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "v", "i", 1, 2) for r in rows], schema).repartition(4)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"block": 8, "stripe": 2, "dims": 3}])
def test_same_as_all_pairs(spark, options):
    rows = rows_of(cloud())
    assert result(egojoin.near_duplicates(frame(spark, rows), **options)) == brute(rows)


def test_awkward_rows(spark):
    x = cloud(dim=6, seed=4)
    rows = rows_of(x[:120]) + [(900, None), (901, []), (902, [0.0] * 6), (903, [None] + [1.0] * 5), (904, [float("nan")] * 6), (905, [float("inf")] + [0.0] * 5), (None, None)]
    rows += [(None, x[0].tolist()), (None, [1e-200] * 6), (3, x[3].tolist()), (3, (-x[3]).tolist()), (906, [1e200] * 6), (907, [3.0, 4.0]), (908, [6.0, 8.1]), (909, [5.0])]
    assert result(egojoin.near_duplicates(frame(spark, rows), block=8)) == brute(rows)
    got = egojoin.near_duplicates(frame(spark, rows).limit(0))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == 0
    # one vector alone, and numbers of single precision
    one = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert result(egojoin.near_duplicates(one)) == [(5, 0, 5, True)]


def test_distant_blocks_are_never_compared(spark):
    """Well separated groups: block pairs grow with the blocks, not with their square."""
    rng = np.random.default_rng(0)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    x = np.repeat(centres, 32, axis=0) + 0.01 * rng.normal(size=(512, 16))
    classes = egojoin._classes(spark.createDataFrame(rows_of(x), "id long, v array<double>"))
    axes = egojoin._axes(classes, 16)
    blocks = egojoin._blocks(egojoin._ordered(classes, axes, 0.3162, 16, False), 16)
    n, pairs = blocks.count(), egojoin._block_pairs(blocks, 0.3162, 16).count()
    assert n >= 32 and pairs < 4 * n < n * (n + 1) // 2


def test_forest_connects_what_its_links_connect():
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 60, (2, 45))
    node, root = egojoin.forest(i, j, 60)
    label = np.arange(60)
    for _ in range(60):
        for a, b in zip(i, j):
            label[[a, b]] = min(label[a], label[b])
    assert len(set(node)) == len(node) and dict(zip(node.tolist(), root.tolist())) == {k: int(v) for k, v in enumerate(label) if k != v}
