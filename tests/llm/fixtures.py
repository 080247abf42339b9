"""Small tables with everything awkward in them."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASH = "fp string, node int, key string, size string, bucket int, w string, score string, label string, first string, _key string, grp string, `a.b` int"


def words(rng, n, kind="en"):
    parts = {"en": ["the", "and", "ing", "tion", "wh", "ou", "er", "st"], "de": ["sch", "ung", "der", "keit", "zu", "ein", "ich", "ß"], "fr": ["eau", "oi", "é", "tre", "que", "ç", "les", "ai"]}[kind]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def docs(spark, n=60, seed=0, clash=True):
    """Three languages, three sources and none, copies, near copies, a long text, and rows with nulls."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, words(rng, rng.randint(1, 80), lang).capitalize() + ".", lang, ["s1", "s2", "s3", None][i % 4], 1))
    base = words(rng, 200)
    rows += [(100, base, "en", "s1", 1), (101, base, "en", "s2", 1), (102, base + " end", "en", "s1", 1), (103, base, None, None, None)]
    rows += [(110, None, "en", "s1", 0), (111, "", None, "s2", 0), (112, "  \n\t ", "fr", None, 2), (113, "123 456 !!", "de", "s3", 3), (114, "a", "en", "s1", 1)]
    rows += [(120, words(rng, 30_000, "de"), "de", "s3", 1), (130, rows[0][1], "en", "s1", 1), (130, rows[0][1], "en", "s1", 1)]
    rows += [(None, "no id here at all", "en", "s2", 1), (None, None, None, None, None)]
    rng.shuffle(rows)
    if not clash:
        return spark.createDataFrame(rows, DOCS)
    more = ("x", 1, "k", "z", 2, "w", "s", "l", "f", "q", "g", 7)
    return spark.createDataFrame([r + more for r in rows], f"{DOCS}, {CLASH}").repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
