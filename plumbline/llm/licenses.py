"""License scan by an exact set-similarity join of text blocks with templates, in DataFrame functions alone.

A text is its words. A template is a set of words; it has a window, the power of two from twice its number of words on.
A text matches a template if a block of so many words, beginning at any word, contains at least ``THRESHOLD`` of
the template's words. The join finds every such block without comparing all:

* Words are ordered by how often they occur in the whole corpus, the rarest first.
* Prefix filter: with m words of which a are needed, a match holds one of the template's m - a + 1 rarest words.
  Only stretches near such a word are looked at; they are joined on it. A stretch is two windows long and begins at a multiple of the
  window, so every block lies whole in the one that its first word's multiple begins.
* Length filter: a stretch with under a distinct words of templates can't match.
* Positional filter: after the first shared word at place i of the stretch's and j of the template's ordered words, at
  most 1 + min(what remains of either) words can be shared.

What passes is verified by the sets themselves, of the blocks that begin at each of the template's words in the stretch: a
block that begins at another word contains no more than the next of these. Only words of templates are kept of a stretch.

A few phrases are found as places where their words stand one after the other.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import stored, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Lines by which texts name a license, and whole public license texts.
TEMPLATES = [
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("gpl", "licensed under the gnu general public license version"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("proprietary", "no part may be reproduced without prior written permission"),
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
        AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
        WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must
        be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
        altered from any source distribution.""",
    ),
]
THRESHOLD = 0.9


def sets_of(templates, threshold: float = THRESHOLD) -> list[tuple[str, int, int, list[str]]]:
    """label, window, number of words needed, distinct words in order, of every template."""
    out = []
    for label, text in templates:
        said = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
        if not said:
            raise ValueError(f"the template of {label} has no words")
        words = sorted(set(said))
        out.append((label, 1 << (2 * len(said) - 1).bit_length(), ceil(threshold * len(words) - 1e-9), words))
    return out


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _lowered(text: Column) -> Column:
    """A-Z in lower case. Spark's lower() also maps other letters, which stay words of their own; only the kelvin
    sign would become an ASCII letter, so it is replaced by another letter first."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ß")))


def _worded(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row), w (its words)."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["doc_id"], docs["text"]).alias("key"), _lowered(docs["text"]).alias("low"))
    return rows.select("doc_id", "key", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)).alias("w"))


def _phrase_places(phrase: str) -> str:
    words = phrase.split()
    here = " AND ".join(f"w[i + {j}] = '{x}'" if j else f"w[i] = '{x}'" for j, x in enumerate(words))
    return f"CASE WHEN array_contains(w, '{max(words, key=len)}') AND size(w) >= {len(words)} THEN filter(sequence(0, size(w) - {len(words)}), i -> {here}) ELSE cast(array() AS array<int>) END"


def scan(docs: DataFrame, phrases=None, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    ``score`` is 1 where a phrase stands, else the largest share of a matching template that a block contains, else 0. Nulls: a
    null text is an empty one; a null doc_id is kept. Repeated rows come back as often. Labels of a text without any are
    the empty string, and its places null. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    sets = sets_of(templates, threshold)
    vocabulary = sorted({x for *_, words in sets for x in words})
    worded = _worded(docs)

    # how often each word of a template occurs in all texts
    said = worded.select(F.explode(F.expr(f"filter(w, x -> x IN ({_quoted(vocabulary)}))")).alias("word"))
    often = {r[0]: r[1] for r in said.groupBy("word").count().collect()}
    ordered = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(ordered)}
    index = []
    for t, (label, window, need, words) in enumerate(sets):
        ranks = sorted(rank[w] for w in words)
        index += [(r, window, t, label, j, need, ranks) for j, r in enumerate(ranks[: len(ranks) - need + 1])]

    labels = sorted(set(phrases.values()))
    by_label = {x: F.expr(f"concat({', '.join(_phrase_places(p) for p, q in sorted(phrases.items()) if q == x)})") for x in labels}
    placed = worded.withColumns({f"at{i}": by_label[x] for i, x in enumerate(labels)})
    # stretches of every window's length near a word of a prefix
    ranked = f"int(array_position(array({_quoted(ordered)}), w[i]))"
    blocks = []
    for window in sorted({x[1] for x in index}):
        rare = _quoted(sorted({ordered[x[0] - 1] for x in index if x[1] == window}))
        known = _quoted(sorted({w for _, size, _, words in sets if size == window for w in words}))
        hits = f"CASE WHEN arrays_overlap(w, array({rare})) THEN filter(sequence(0, size(w) - 1), i -> w[i] IN ({rare})) ELSE cast(array() AS array<int>) END"
        numbers = f"concat(transform(hits{window}, i -> int(i div {window})), transform(hits{window}, i -> int(i div {window}) - 1))"
        placed = placed.withColumn(f"hits{window}", F.expr(hits)).withColumn(f"nos{window}", F.expr(f"filter(array_distinct({numbers}), b -> b >= 0)"))
        held = f"filter(sequence(b * {window}, least((b + 2) * {window}, size(w)) - 1), i -> w[i] IN ({known}))"
        blocks.append(F.expr(f"transform(nos{window}, b -> struct({window} AS window, b AS block, transform({held}, i -> struct(i AS at, {ranked} AS rank)) AS held))"))
    starts = F.concat(*[F.col(f"at{i}") for i in range(len(labels))])
    base = F.array_compact(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(x)) for i, x in enumerate(labels)]))
    texts = placed.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), starts.alias("starts"), base.alias("base"), F.concat(*blocks).alias("blocks"))
    texts = stored(texts, "texts")

    near = texts.select("doc_id", "key", F.explode("blocks").alias("k")).select("doc_id", "key", "k.*")
    near = near.withColumn("ranks", F.expr("array_sort(array_distinct(transform(held, h -> h.rank)))"))
    prefix = ", ".join(str(r) for r in sorted({x[0] for x in index}))
    words = near.select("*", F.explode(F.expr(f"filter(transform(ranks, (r, i) -> struct(r AS rank, i AS i)), x -> x.rank IN ({prefix}))")).alias("x")).select("*", "x.*")
    schema = "rank int, window int, template int, label string, j int, need int, template_ranks array<int>"
    pairs = words.join(F.broadcast(spark.createDataFrame(index, schema)), ["rank", "window"])  # a few rows a template
    left = F.lit(1) + F.least(F.size("template_ranks") - F.col("j") - 1, F.size("ranks") - F.col("i") - 1)
    pairs = pairs.where((F.size("ranks") >= F.col("need")) & (left >= F.col("need")))
    # a stretch and a template meet on the rarest word they share, and are verified once
    shared = F.array_intersect("ranks", "template_ranks")
    pairs = pairs.where((F.array_min(shared) == F.col("rank")) & (F.size(shared) >= F.col("need")))
    pairs = pairs.withColumn("held", F.expr("filter(held, h -> array_contains(template_ranks, h.rank))"))
    held = "size(array_distinct(transform(filter(held, h -> h.at >= b.at AND h.at < b.at + window), h -> h.rank)))"
    pairs = pairs.withColumn("most", F.expr(f"array_max(transform(held, b -> {held}))"))
    pairs = pairs.select("doc_id", "key", "label", (F.col("most") >= F.col("need")).alias("met"), (F.col("most") / F.size("template_ranks")).alias("part"))
    matches = pairs.where("met").groupBy("doc_id", "key").agg(F.collect_set("label").alias("found"), F.max("part").alias("part"))
    matches = matches.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "found", "part")

    out = texts.join(matches, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license scan of all documents."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = ", ".join(f"('{x}', {t}, {window}, {need})" for t, (_, window, need, said) in enumerate(sets_of(TEMPLATES)) for x in said)
    names = ", ".join(f"({t}, '{label}', {len(said)})" for t, (label, _, _, said) in enumerate(sets_of(TEMPLATES)))
    labels = sorted(set(PHRASES.values()))

    def places(phrase: str) -> str:
        words = phrase.split()
        here = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(words))
        return f"list_filter(range(0, len(w) - {len(words) - 1}), lambda i: {here})"

    at = {x: " || ".join(places(p) for p, q in sorted(PHRASES.items()) if q == x) for x in labels}
    return f"""
WITH worded AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM documents
), placed AS (
  SELECT r, doc_id, len(w) AS n_words, {", ".join(f"{at[x]} AS at{i}" for i, x in enumerate(labels))} FROM worded
), said AS (
  SELECT r, i, word, t, len, need FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM worded)
  JOIN (VALUES {words}) AS template_words(word, t, len, need) USING (word)
), able AS (
  SELECT r, t FROM said GROUP BY r, t, need HAVING count(DISTINCT word) >= need
), counted AS (
  SELECT r, t, need, count(DISTINCT word) OVER (PARTITION BY r, t ORDER BY i RANGE BETWEEN CURRENT ROW AND len - 1 FOLLOWING) AS held FROM said SEMI JOIN able USING (r, t)
), found AS (
  SELECT r, list(DISTINCT label) AS found, max(held / n) AS part FROM counted JOIN (VALUES {names}) AS names(t, label, n) USING (t) WHERE held >= need GROUP BY r
), joined AS (
  SELECT placed.*, found, part, {" || ".join(f"at{i}" for i in range(len(labels)))} AS starts,
    {" || ".join(f"(CASE WHEN len(at{i}) > 0 THEN ['{x}'] ELSE [] END)" for i, x in enumerate(labels))} AS base
  FROM placed LEFT JOIN found USING (r)
)
SELECT doc_id, n_words, len(starts) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0)::DOUBLE END AS score
FROM joined"""


SQL = _sql()
