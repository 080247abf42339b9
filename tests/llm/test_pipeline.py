"""The pipeline's stages on small tables: each one's decisions are those of its operator."""

import random

import pytest
from fixtures import docs, words

import corpus_pipeline
from plumbline.llm import langid, packing, quality, simhash


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(5)
    rows = [(200 + i, words(rng, 60).replace(" ", "*** ") if i % 4 == 0 else words(rng, 60) + ".", "en", f"s{i % 3}", 1) for i in range(160)]
    table = docs(spark, clash=False).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(200 + i, int(i % 4 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    (_, language), (_, good), (_, one), (_, mixed), (_, packed) = corpus_pipeline.STAGES
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect() if r["doc_id"] is not None)

    first = language(spark, given, sf_dir)
    found = langid.identify(spark, given).where(f"lang_pred <> 'und' AND score >= {langid.MAIN_SHARE}")
    assert first.columns == given.columns and ids(first) == ids(found)

    second = good(spark, first, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert ids(second) == ids(quality.grade(spark, first, labels).where("predicted = 1"))
    assert not {200 + i for i in range(0, 160, 4)} & set(ids(second))  # all poor ones go
    assert len({200 + i for i in range(160) if i % 4} & set(ids(second))) >= 115  # and the clean ones stay

    third = one(spark, second, sf_dir)
    classes = simhash.near_duplicates(second).where("doc_id = component_id")
    assert ids(third) == sorted(set(ids(classes)))

    fourth = mixed(spark, third, sf_dir)
    assert fourth.columns == given.columns and set(ids(fourth)) <= set(ids(third))
    last = packed(spark, fourth, sf_dir)
    assert last.where("start = 0").count() == fourth.count()


def test_run_gives_every_kept_document_whole(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    assert out and all(r["doc_tokens"] == len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids) + 1 for r in out)
