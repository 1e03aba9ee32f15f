import pytest

from atlasq.llm import registry
from tests.conftest import DATA

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_their_parts(spark):
    docs = registry.table(spark, DATA, "documents")
    ids = {r["doc_id"] for r in docs.collect()}
    kept = {r["doc_id"] for r in registry.op2(spark, DATA).where("kept").collect()}
    left = docs.where(docs["doc_id"].isin(*kept))
    classes = {r["class_id"] for r in corpus_pipeline.near_duplicates.op3_near_duplicates(left).collect()}
    dirty = {r["doc_id"] for r in registry.op10(spark, DATA).where("contaminated").collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(out) == classes - dirty and set(out) < ids
    own = corpus_pipeline.bpe.tokenizer(*registry.byte_bpe())
    for r in out.values():
        assert own.decode(r["ids"]).decode() == r["text"] and r["n_chars"] == len(r["text"]) and "@" not in r["text"]


def test_each_stage_takes_odd_and_empty_tables(spark, odd):
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (odd, odd.where("false")):
            out = stage(spark, docs, DATA)
            out.count()
            assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
