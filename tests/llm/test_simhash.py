import numpy as np
import pytest
from fixtures import docs, empty, rows
from xxhash import xxh64_intdigest

from plumbline.llm import simhash
from plumbline.llm.common import components


def plain(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(codes, radius):
    label = list(range(len(codes)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(codes))]


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a b", "a b c", "The CAT  sat\ton THE mat\x0b\x0cÉté É", "x " * 500, "\x1c a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain(text)


def test_hash_is_sparks(spark):
    assert simhash.fingerprint(b"a b c") == int(spark.sql("select hex(xxhash64('a b c'))").first()[0], 16)


def test_gray_rank_orders_the_gray_sequence():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
@pytest.mark.parametrize("spread", [8, 20, 64])
def test_tree_finds_all_pairs(radius, spread):
    rng = np.random.default_rng(radius + spread)
    groups = [np.unique(rng.integers(0, 1 << spread, n, dtype=np.uint64)) for n in (1, 2, 7, 8, 9, 64, 65, 200)]
    groups = [g[np.argsort(simhash.gray_rank(g))] for g in groups]
    sizes = np.array([len(g) for g in groups])
    codes, starts = np.concatenate(groups), np.cumsum(sizes) - sizes
    a, b = simhash.near_pairs(codes, starts, sizes, radius)
    want = {(s + i, s + j) for s, n in zip(starts, sizes) for i in range(n) for j in range(i + 1, n) if int(codes[s + i] ^ codes[s + j]).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_parts_hold_every_varying_bit_once(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    masks = [sum(1 << int(b) for b in rng.choice(64, v, replace=False)) for v in range(3, 65)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = spark.createDataFrame([(m,) for m in signed], "v long").select("v", simhash._parts(F.col("v"), 3).alias("m")).collect()
    for r in rows:
        a, b, c = (x & (2**64 - 1) for x in r["m"])
        assert a and b and c and a ^ b ^ c == a | b | c == r["v"] & (2**64 - 1)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 2, 3)


@pytest.mark.parametrize("leaf", [4, 256])
def test_index_connects_like_brute_force(spark, leaf):
    rng = np.random.default_rng(leaf)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    codes = {int(c) ^ sum(1 << int(b) for b in rng.choice(64 if i % 2 else 12, rng.integers(0, 4), replace=False)) for c in centres for i in range(25)}
    codes |= {0, (1 << 64) - 1, (1 << 64) - 2}
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), 2, leaf)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    want = classes(codes, 2)
    group = {}
    for c, s, w in zip(codes, signed, want):
        group.setdefault(w, set()).add(s)
    for members in group.values():
        assert {roots.get(m, m) for m in members} == {min(members)}


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


def test_awkward_rows(spark):
    table = docs(spark)
    given = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    assert sum(d is None for d, _ in given) == 2
    codes = [plain(t) for _, t in given]
    label = classes(codes, 2)
    least = {}
    for (d, _), c in zip(given, label):
        least[c] = min(d, least.get(c, d), key=lambda x: (x is None, x or 0))
    want = sorted(((d, c - (1 << 64) if c >> 63 else c, least[k]) for (d, _), c, k in zip(given, codes, label)), key=repr)
    assert rows(simhash.near_duplicates(table)) == want
    kept = simhash.keep_one(spark, table, "")
    assert kept.columns == table.columns
    # one row of each class stays, also where no row of it has an id
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(least.values(), key=repr)


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(spark, empty(spark), "").count() == 0


def test_texts_that_share_an_id(spark):
    """Each is judged by its fingerprint; only copies of one text under one id are one row."""
    a, b, c = "one text of some words here", "quite another thing is written below", "the third is unlike both of them"
    given = [(1, a, "x"), (1, b, "x"), (2, b, "x"), (3, c, "y"), (3, c, "z"), (4, c, "x")]
    table = spark.createDataFrame(given, "doc_id long, text string, source string")
    kept = [sorted(tuple(r) for r in simhash.keep_one(spark, table.repartition(n, "source"), "").collect()) for n in (1, 3)]
    assert kept[0] == kept[1]
    assert [r[:2] for r in kept[0]] == sorted([(1, a), (1, b), (3, c)])
