"""Spelling variants against a plain count of all pairs."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from fixtures import docs, empty

from plumbline.llm import spelling


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, slip=31, times=10):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= times * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def corpus():
    """Common words with one, two and three slips, equal counts, edits at both ends, accents, capitals and a very long run."""
    rng = random.Random(3)
    base = ["Straßenbahn", "éclatante", "aaaaaaaa", "nightingale", "ÀÉÎÕÜßÿ÷", "mississippi"]
    words = []
    for w in base:
        words += [w] * rng.choice([40, 300])
        for _ in range(12):
            v = w
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(v) + 1)
                v = rng.choice([v[:at] + rng.choice("abnßé") + v[at:], v[:at] + v[at + 1 :], v[:at] + rng.choice("abn") + v[at + 1 :]])
            words += [v] * rng.randint(1, 6)
    words += ["whippoorwill"] * 900 + ["whippoorwil"] * 60 + ["whippoorwi"] * 4  # a chain of forms
    words += ["x" * 70 + "yz", "x" * 70 + "yy", "x" * 71 + "yz"] * 3 + ["longer" * 4000] * 2
    rng.shuffle(words)
    return [(i, rng.choice(["1 ", ", ", "\n"]).join(words[40 * i : 40 * i + 40])) for i in range(len(words) // 40 + 1)]


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 64])
def test_same_as_all_pairs(spark, filter_bytes):
    rows = [*corpus(), (None, "Straßenbahn nightingale " * 3), (None, None), (7, ""), (8, "nightingale " * 200)]
    got = spelling.variants(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string").repartition(5), filter_bytes=filter_bytes)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert {tuple(r) for r in got.collect()} == want and any(r[1] and r[1] != r[2] for r in want)


def test_awkward_rows(spark):
    table = docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert {tuple(r) for r in spelling.variants(table).collect()} == brute(rows)
    assert spelling.variants(empty(spark)).count() == 0


def test_hashes_of_edits_are_those_of_the_words():
    word = "banana"
    letters = np.frombuffer(word.encode(), np.uint8).reshape(1, -1)
    alphabet = np.frombuffer(b"abnz", np.uint8)
    made = []
    for length, rows, at, c, code in spelling.edits(letters, alphabet):
        for i, h in zip(at.tolist(), code.tolist()):
            new = word[:i] + ("" if c is None else chr(c)) + word[i + 1 :]
            assert len(new) == length and h == int(spelling._codes(np.frombuffer(new.encode(), np.uint8).reshape(1, -1))[0])
            made.append(new)
    assert len(made) == len(set(made)) and {"anana", "canana"[1:], "zanana", "bbnana"} <= set(made)


def test_filters_lose_no_word():
    words = [f"word{i:05d}".encode() for i in range(5000)]
    letters = np.frombuffer(b"".join(words), np.uint8).reshape(5000, -1)
    for waves in (1, 3):
        f = spelling.Filters({9: 5000}, waves)
        code, hits = spelling._codes(letters), 0
        for wave in range(waves):
            row = np.zeros(f.numbers, np.uint64)
            w, one, a, other, b = f.places(code, 9)
            for at, bits in ((one, a), (other, b)):
                np.bitwise_or.at(row, at[w == wave].astype(np.int64), bits[w == wave])
            hits += len(f.holds(row, wave, code, 9))
            false = f.holds(row, wave, code * np.uint64(3), 9)
            assert len(false) < 100
        assert hits == 5000
