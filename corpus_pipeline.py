"""From raw documents to packed training sequences.

Every stage takes the documents that the one before it kept and returns them with the columns of ``documents``:
those without a main language go, then those of poor quality, then all but one of each class of near-duplicates;
the rest is repeated or thinned out to the sources' target weights; and the last stage returns the packed pieces with
their ids. Labels and languages are learned from the documents that reach the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import langid, mixing, packing, quality, simhash
from plumbline.llm.common import stored, table

STAGES = [
    ("language", langid.keep_known),
    ("quality", quality.keep_good),
    ("near_duplicates", simhash.keep_one),
    ("mixing", mixing.repeat_to_weights),
    ("packing", packing.pack_sequences),
]

#: SQL can't express the learned models, the draws and the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
