"""Every dealt operator and stage on edge rows and on an empty table."""

import corpus_pipeline
import public_tokenizers
import pytest

from panelwise.llm import (best_fit_packing, byte_cnn, flow_resharding, license_dice, order_minhash, pii_surrogates,
                           quality_divergence, source_mixing)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "quality": lambda d: quality_divergence.divergence_report(d),
    "packing": lambda d: best_fit_packing.pack_documents(d, VOCABULARY),
    "pii": lambda d: pii_surrogates.replace_entities(d, "k"),
    "mixing": lambda d: source_mixing.mix_documents(d),
    "near": lambda d: order_minhash.near_duplicate_classes(d),
    "cnn": lambda d: byte_cnn.score_documents(d, byte_cnn.ByteCnn()),
    "license": lambda d: license_dice.scan_documents(d),
    "shards": lambda d: flow_resharding.sharded_report(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(edge_docs, name):
    rows = OPERATORS[name](edge_docs).collect()
    ids = [r["doc_id"] for r in rows]
    if name == "packing":
        ids = [r["doc_id"] for r in rows if r["piece"] == 0]
    assert sorted(map(str, ids)) == sorted(["1", "1", "2", "3", "4", "None", "5", "6", "7", "8"])


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(edge_docs, name):
    assert OPERATORS[name](edge_docs.limit(0)).collect() == []


def test_stages_keep_the_columns(spark, edge_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (edge_docs, edge_docs.limit(0)):
            found = stage(spark, docs, "")
            assert found.columns == docs.columns
            found.collect()


def test_near_classes_of_edge_rows(edge_docs):
    found = {(r["doc_id"], r["class_id"], r["kept"]) for r in order_minhash.near_duplicate_classes(edge_docs).collect()}
    assert {(1, 1, True), (2, 1, False), (8, 1, False), (3, 3, True), (None, None, True)} <= found
    kept = [r["doc_id"] for r in order_minhash.without_near_duplicates(edge_docs).collect()]
    assert sorted(map(str, kept)) == sorted(["1", "3", "4", "5", "6", "7", "None"])


def test_mix_bounds(edge_docs):
    for r in source_mixing.mix_documents(edge_docs).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
