import corpus_pipeline
import pytest
from test_near_copies import brute_set, similar
from test_simhash import brute_groups

from tessera.llm import packing, quality, toxicity

FOLDER = "/root/testdata/sf0.01"


def near_groups(docs):
    """{doc_id: smallest of its group} by the Jaccard similarity of every pair that shares a shingle."""
    sets = {r.doc_id: brute_set(r.text) for r in docs.collect()}
    holders = {}
    for doc_id, some in sets.items():
        for shingle in some:
            holders.setdefault(shingle, []).append(doc_id)
    met = {(a, b) for ids in holders.values() for i, a in enumerate(ids) for b in ids[:i]}
    return brute_groups(list(sets), lambda a, b: ((a, b) in met or (b, a) in met) and similar(sets[a], sets[b]))


def test_stages_in_order_and_each_keeps_the_columns_of_documents(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    ids = {r.doc_id for r in docs.collect()}
    decide = [
        lambda kept: ids - toxic,
        lambda kept: {r.doc_id for r in quality.judge(kept).where("kept").collect()},
        lambda kept: set(near_groups(kept).values()),
    ]
    for (_, stage), expected in zip(corpus_pipeline.STAGES[:-1], decide, strict=True):
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r.doc_id for r in rows} == expected(docs) and len(rows) == len({r.doc_id for r in rows})
        docs = docs.where(docs.doc_id.isin([r.doc_id for r in rows]))
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    want = packing.pieces(docs, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, packed.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


@pytest.mark.parametrize("number", range(3))
def test_stage_with_missing_empty_and_very_long_texts(spark, edge_docs, number):
    long_text = " ".join(f"word{i % 9973} the and" for i in range(60_000))
    docs = edge_docs([None, "", " \n\t", "a", long_text, "the house of the man is old and the garden is green " * 3])
    out = corpus_pipeline.STAGES[number][1](spark, docs, FOLDER)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    # nothing is toxic; short and repetitive texts are no good; what has no words is one group
    assert kept == [{0, 1, 2, 3, 4, 5}, quality_keeps(docs), {0, 3, 4, 5}][number]


def quality_keeps(docs):
    return {r.doc_id for r in quality.judge(docs).where("kept").collect()}


def test_empty_table_goes_through_all_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0 or docs.columns
    assert docs.count() == 0
