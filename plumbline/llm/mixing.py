"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / size times on average: a whole number of copies
and a fraction. The fractions are rounded by pairs. A random one of two documents gains what the other
loses, counted in words, until one fraction is 0 or 1; the other goes on to the next pair. The chance
of either way is such that each document's mean stays. So the words of a source stay as they are at
every step, and in the end only one document's fraction is rounded alone.

Equal rows are one entry: of m rows with the fraction p, floor(m * p) gain a copy, which is what rounding them by pairs
comes to, and one row with what is left of m * p takes part in the rest.

Pairs are formed within small buckets of entries, drawn by a hash. Each leaves at most one open
document a source; these meet in groups of ``FAN`` buckets, and so on, in a tree whose every level is one
Spark job over fewer rows. No task sees more than a bucket of a source, however large the source is.
All draws are hashes of the documents' keys, so that reruns agree whatever the partitions.
"""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.common import batched, stored, table
from plumbline.operators.ranks import numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
SEED = 17
#: Entries of a bucket on average, and buckets that meet on the next level.
BUCKET = 1_000
FAN = 32
#: Rows that one task makes of an entry at once.
PART = 10_000

_EPS = 1e-12


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    Sources in order of code points (null last) take ``weights`` by turns and share ``share`` of all sizes by them. No
    target is above ``most`` times its source's size: targets are min(most * size, weight * level) at the one
    level where they add up. The level rises until no further source reaches its limit.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(per.select("source", "source_size", F.col("source").isNull().alias("_last")), ["_last", "source"])
    turns = F.array(*[F.lit(float(w)) for w in weights])
    weighted = stored(ranked.select("source", "source_size", F.element_at(turns, (F.col("row_no") % len(weights) + 1).cast("int")).alias("weight")), "sources")
    total = float(weighted.agg(F.sum("source_size")).first()[0] or 0) * share
    limit = F.col("source_size") * F.lit(float(most))
    level, full = 0.0, -1
    while True:
        held = limit <= F.col("weight") * F.lit(level)
        n, spent, open_weight = weighted.agg(F.count_if(held), F.sum(F.when(held, limit)), F.sum(F.when(~held, F.col("weight")))).first()
        if n == full or not open_weight:
            break
        full, level = n, (total - (spent or 0.0)) / open_weight
    target = F.least(limit, F.col("weight") * F.lit(level)) if open_weight else limit
    return weighted.select("source", "source_size", target.alias("target"))


def _uniform(a: int, b: int, level: int) -> float:
    """A draw in [0, 1) from two keys and a level."""
    x = (a ^ (b * 0x9E3779B97F4A7C15) ^ (level * 0xD1B54A32D192ED03) ^ SEED) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def pivot(p: list[float], words: list[int], keys: list[int], level: int = 0, last: bool = False) -> list[float]:
    """Round fractions so that the sum of p * words stays. At most one is left open; with ``last`` it is drawn alone.

    With the longest first, neighbours are of like length and the one left open is among the shortest.
    """
    out = list(p)
    a = -1
    for b in range(len(out)):
        if not _EPS < out[b] < 1 - _EPS or words[b] == 0:
            out[b] = float(_uniform(keys[b], 0, level) < out[b])  # no words: nothing to keep level
            continue
        if a < 0:
            a = b
            continue
        up = min((1 - out[a]) * words[a], out[b] * words[b])
        down = min(out[a] * words[a], (1 - out[b]) * words[b])
        move = up if _uniform(keys[a], keys[b], level) * (up + down) < down else -down
        out[a] += move / words[a]
        out[b] -= move / words[b]
        out[a], out[b] = (round(x) if min(x, 1 - x) < _EPS else x for x in (out[a], out[b]))
        a = a if 0 < out[a] < 1 else b if 0 < out[b] < 1 else -1
    if last and a >= 0:
        drawn = float(_uniform(keys[a], 1, level) < out[a])
        over = (drawn - out[a]) * words[a]
        out[a] = drawn
        # that one draw moved the sum; turn other rounded fractions round, longest first, as long as the sum comes nearer
        for b in sorted((b for b in range(len(out)) if b != a and _EPS < p[b] < 1 - _EPS), key=lambda b: (-words[b], keys[b])):
            if out[b] == (over > 0) and 0 < words[b] < 2 * abs(over):
                out[b] = 1.0 - out[b]
                over += words[b] if out[b] else -words[b]
    return [float(x) for x in out]


_SCHEMA = "doc_id long, source string, size long, key long, rows long, base int, whole long, bucket long, p double"


def _round_level(level: int, last: bool):
    """Rows come sorted by bucket and source; every run of equal (bucket, source) is rounded."""

    def solve(parts):
        rows = pa.Table.from_batches(parts).combine_chunks()
        p = pivot(rows["p"].to_pylist(), rows["size"].to_pylist(), [k & 0xFFFFFFFFFFFFFFFF for k in rows["key"].to_pylist()], level, last)
        yield from rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64())).to_batches()

    def run(batches):
        held, at = [], None  # the open run, and its bucket and source
        for b in batches:
            ids = list(zip(b["bucket"].to_pylist(), b["source"].to_pylist()))
            begin = 0
            for i, x in enumerate(ids):
                if x != at:
                    held += [b.slice(begin, i - begin)] if i > begin else []
                    if held:
                        yield from solve(held)
                    held, at, begin = [], x, i
            held += [b.slice(begin)] if len(ids) > begin else []
        if held:
            yield from solve(held)

    return run


def entries(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """doc_id, key, source, size, source_size, target, rows, base, more: every one of the ``rows`` equal rows is taken ``base``
    times, and ``more`` of them once more."""
    words = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), words.alias("size"), F.xxhash64(docs["doc_id"], docs["text"]).alias("key"))
    distinct = stored(rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("rows")), "sizes")
    targets = stored(source_targets(distinct.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share, most), "targets")
    ratio = F.when(targets["source_size"] > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    buckets = max(1, ceil(distinct.count() / BUCKET))
    aimed = distinct.join(targets.select(F.col("source").alias("_s"), ratio.alias("_ratio")), distinct["source"].eqNullSafe(F.col("_s")))
    base = F.floor(F.col("_ratio") + _EPS).cast("int")
    more = F.greatest(F.col("_ratio") - base, F.lit(0.0)) * F.col("rows")
    whole = F.floor(more + F.col("rows") * _EPS)
    open_rows = aimed.select(
        "doc_id", "source", "size", "key", "rows", base.alias("base"), whole.alias("whole"), F.pmod("key", F.lit(buckets)).alias("bucket"), F.greatest(more - whole, F.lit(0.0)).alias("p")
    )
    done, level = [], 0
    while True:
        last = buckets == 1
        dealt = open_rows.repartition("bucket", "source").sortWithinPartitions("bucket", "source", F.desc("size"), "key", "doc_id")
        rounded = stored(batched(dealt, _round_level(level, last), _SCHEMA), f"level{level}")
        closed = F.col("p").isin(0.0, 1.0)
        done.append(rounded.where(closed))
        if last:
            break
        buckets, level = ceil(buckets / FAN), level + 1
        open_rows = rounded.where(~closed).withColumn("bucket", F.floor(F.col("bucket") / F.lit(FAN)))
    out = done[0]
    for further in done[1:]:
        out = out.unionByName(further)
    out = out.join(targets.withColumnRenamed("source", "_s"), out["source"].eqNullSafe(F.col("_s")))
    return out.select("doc_id", "key", "source", "size", "source_size", "target", "rows", "base", (F.col("whole") + F.col("p").cast("long")).alias("more"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """doc_id, key, source, size, source_size, target, copies: how often the mix takes each row.

    ``key`` is a hash of doc_id and text. Nulls: a null text has size 0, a null source is a source of its own and comes
    last, a null doc_id is an id like any other. Rows equal in doc_id, text and source are rounded as one entry and come back as
    often; their copies differ by one at most. A source without words has target 0. An empty table gives no rows.
    """
    found = entries(docs, weights, share, most)
    kinds = F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("more").alias("n")), F.struct(F.col("base").alias("copies"), (F.col("rows") - F.col("more")).alias("n")))
    found = found.withColumn("kind", F.explode(F.filter(kinds, lambda k: k["n"] > 0)))
    # an entry of very many rows is spread before it becomes rows again
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(kind.n - 1) div {PART}")))
    found = found.withColumn("part", parts).repartition("key", "part")
    left = F.least(F.lit(PART), F.col("kind.n") - F.col("part") * PART).cast("int")
    found = found.withColumn("_row", F.explode(F.array_repeat(F.lit(0), left)))
    return found.select("doc_id", "key", "source", "size", "source_size", "target", F.col("kind.copies").alias("copies"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def repeat_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns.

    Null texts and texts without words have no size, so a mix takes or leaves them by chance; null ids and sources are values
    like any other. Equal rows share the copies of all of them. An empty table gives no rows.
    """
    found = entries(docs)
    copies = F.sum(F.col("rows") * F.col("base") + F.col("more"))
    taken = found.groupBy("key", "doc_id").agg(F.sum("rows").alias("_rows"), copies.alias("_copies"))
    taken = stored(taken.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), "_rows", "_copies"), "copies")
    # the row goes as one struct, so that its columns may have any names
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64(docs["doc_id"], docs["text"]).alias("key"), docs["doc_id"].alias("id"))
    rows = rows.join(taken, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
    # equal rows share their copies: each takes the whole part, the first ones one more
    place = F.row_number().over(Window.partitionBy("key", "id").orderBy("key"))
    each = F.floor(F.col("_copies") / F.col("_rows")) + (place <= F.col("_copies") % F.col("_rows")).cast("int")
    rows = rows.select("row", each.cast("int").alias("each")).where("each > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("each")))).select("row.*")
