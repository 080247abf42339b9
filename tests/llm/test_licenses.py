import random
import re
from collections import Counter
from math import ceil

from fixtures import docs, empty

from plumbline.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORD.findall((text or "").translate(UPPER))
    at = {label: [] for label in licenses.PHRASES.values()}
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at[label] += [i for i in range(len(w)) if w[i : i + len(p)] == p]
    every = sorted(i for x in at.values() for i in x)
    base = {k for k, v in at.items() if v}
    found, score = set(base), 1.0 if base else 0.0
    for label, text_ in licenses.TEMPLATES:
        said = WORD.findall(text_.translate(UPPER))
        window, t = next(x for x in (2**k for k in range(1, 20)) if x >= 2 * len(said)), set(said)
        held = Counter(x for x in w[: window - 1] if x in t)
        for start in range(len(w)):  # the block of `window` words that begins here, or what is left of the text
            if start + window <= len(w):
                held[w[start + window - 1]] += w[start + window - 1] in t
            n = sum(x > 0 for x in held.values()) if w[start] in t else 0
            if n >= ceil(licenses.THRESHOLD * len(t) - 1e-9):
                found.add(label)
                score = max(score, n / len(t))
            held[w[start]] -= w[start] in t
    return len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(found)), score


def test_like_brute_force(spark):
    rng = random.Random(0)
    pool = sorted({w for _, t in licenses.TEMPLATES for w in t.split()}) + ["cc", "by", "all", "rights", "reserved", "É", "K", "mIT", "x1"]
    lines = [" ".join(rng.choices(pool, k=rng.randint(0, 120))) for _ in range(150)]
    for _ in range(150):
        filler = lambda: rng.choices(["foo", "bar", "the", "license"], k=rng.randint(0, 40))
        t = rng.choice(licenses.TEMPLATES[:12])[1].upper().split()
        lines.append("; ".join([*filler(), *t[: rng.randint(len(t) - 2, len(t))], *filler()]))
    for label, text in licenses.TEMPLATES[12:] * 4:  # whole texts: some words missing, others between them
        cut = rng.random() * 0.15
        said = [x for x in text.split() if rng.random() > cut]
        lines.append(" ".join(y for x in said for y in ([x, "foo"] if rng.random() < 0.4 else [x])))
    lines += ["CC BY", "cc by cc by cc BY-NC 4.0", "All\nRights-Reserved", "GNU General Public License, version 3", "Known cc by", "gnu K public", None, "", "..."]
    found = licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == {i: brute(t) for i, t in enumerate(lines)}


def test_blocks_begin_at_every_word(spark):
    """A template spread over as many words as its window allows is found wherever it begins, and not beyond."""
    t = licenses.TEMPLATES[2][1].split()
    spread = " foo ".join(t) + " foo" * (28 - 2 * len(t))
    other = "bar " * 3 + " foo foo foo ".join(t)
    lines = [(i, "bar " * i + spread) for i in range(70)] + [(100, other)]
    found = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert found == {i: "bsd" for i in range(70)} | {100: ""}


def test_whole_texts(spark):
    lines = [(i, f"code here\n{text}\nmore") for i, (_, text) in enumerate(licenses.TEMPLATES)]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert all(label in found[i]["labels"].split(",") and found[i]["score"] == 1.0 for i, (label, _) in enumerate(licenses.TEMPLATES))


def test_native_plan(spark):
    plan = licenses.scan(docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_awkward_rows(spark):
    table = docs(spark)
    found = sorted(map(repr, (tuple(r) for r in licenses.scan(table).collect())))
    assert found == sorted(repr((r["doc_id"], *brute(r["text"]))) for r in table.select("doc_id", "text").collect())
    assert licenses.scan(empty(spark)).count() == 0
