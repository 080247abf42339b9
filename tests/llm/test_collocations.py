"""Collocations against a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import docs, empty

from plumbline.llm import collocations as co


def brute(rows, count=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= count}
    out = {}
    for p, a in found.items():
        lang = p[0]
        if any(len(q) == 4 and q[0] == lang and p[1:] in (q[1:3], q[2:4]) and 100 * b >= covered * a for q, b in found.items()) and len(p) == 3:
            continue
        cuts = [(1_000_000 * a * a // (f[p[: k + 1]] * f[(lang, *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(lang, *p[k + 1 :])]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, ps in out.items() for i, (s, a, p, l, r) in enumerate(sorted(ps)[:top])}


def corpus(seed=0, n=60):
    """Few words in many orders, signs that end pieces, tabs, null languages and texts, a very long text, ties."""
    rng = random.Random(seed)
    words = ["New", "York", "City", "ünder", "a", "of", "the", "x y", "ß", "\x01c", "é"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "!?", "\r\n"]) for _ in range(rng.randint(0, 120)))
        rows.append((["en", "de", None, "und", ""][i % 5], text))
    rows += [("en", "New York City " * 3000), ("de", None), (None, ""), ("fr", "?!"), ("en", "tie one tie two " * 20)]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 500, "range_words": 300}, {"top": 5}, {"count": 3, "covered": 90}])
def test_same_as_a_plain_count(spark, options):
    rows = corpus()
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, n int, phrase string, range int").repartition(7)
    got = co.collocations(table, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    plain = {k: v for k, v in options.items() if k not in ("shard_bytes", "range_words")}
    assert {tuple(r) for r in got.collect()} == brute(rows, **plain)


def test_awkward_rows(spark):
    table = docs(spark)
    rows = [(r["lang"], r["text"]) for r in table.collect()]
    assert {tuple(r) for r in co.collocations(table, range_words=5_000).collect()} == brute(rows)
    assert co.collocations(empty(spark)).count() == 0


def windows(rows):
    return co.windows(pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()))


def paths(w):
    word = ["", *w.words.to_pylist()]
    return {(w.langs[l], word[a], word[b], word[c]): n for l, a, b, c, n in zip(*(x.tolist() for x in w[2:]))}


def test_an_automaton_holds_its_windows_and_shares_states():
    w = windows(corpus())
    auto = co.Automaton.unpack(co.Automaton.build(w).pack())
    assert paths(auto.windows()) == paths(w)
    # ways on that are the same are one state
    same = windows([("en", f"w{i} x y") for i in range(500)])
    assert len(co.Automaton.build(same).two[0]) < 10 < len(co.Automaton.build(same).one[1])


def test_union_adds_up_and_cuts_split():
    rows = corpus()
    parts, whole = [windows(rows[i::4]) for i in range(4)], windows(rows)
    assert paths(co.union(parts)) == paths(whole)
    bounds = [("de", "of", "the"), ("en", "new", "york"), ("en", "zz", "a"), ("zz", "", "")]
    cuts = [0, *co._cuts(whole, bounds).tolist(), len(whole.n)]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        for lang, a, b, _ in paths(co._piece(whole, lo, hi)):
            assert (not i or bounds[i - 1] <= (lang, a, b)) and (i == len(bounds) or (lang, a, b) < bounds[i])


def test_weights_of_parts():
    rows = corpus()
    f, w = Counter(), paths(windows(rows))
    for (lang, a, b, _), n in w.items():
        f[lang, a, None] += n
        f[lang, a, b or "nothing"] += n
    auto = co.Automaton.build(windows(rows))
    asked = [("en", "new", None), ("en", "new", "york"), ("de", "ß", "a"), ("fr", "new", None), ("xx", "new", None), ("en", "none", None), ("en", "new", "none")]
    assert auto.weights(*(list(x) for x in zip(*asked))).tolist() == [f[x] for x in asked]
    assert np.array_equal(co.Automaton.build(windows([])).weights(["en"], ["a"], [None]), [0])
