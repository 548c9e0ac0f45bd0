"""Arrow files of token sequences against the tokenizer on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelwise.llm import arrow_sequences, queries
from panelwise.llm.arrow_sequences import SequenceFile, SequenceWriter
from panelwise.llm.shared import scratch_path
from panelwise.llm.token_ids import WordIds

SF001 = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
FULL = Tokenizer.from_file(VOCABULARY)
ODD = ["a\x1cb c", "Σας ΣΑΣ İstanbul œuvre ŒUVRE", "it's DON'T x's. \"quoted\" (par) a--b", "", "  lead  and trail \n", None,
       "\xa0nb sp\x85x ä Ä ﬁ 12345 3.14 a_b ª º µ ²", "<|endoftext|> 中文 テスト ١٢ ﷺ", "word'", "...", "é" * 5, "ABC... ﻿x y​z", "ʼn ŉ ǅ K Å"]


def _ids(text):
    return FULL.encode(text or "", add_special_tokens=False).ids


def _expected(rows):
    """Per row in order: (doc_id, start, n_tokens, ids_crc32)."""
    at, found = 0, []
    for doc_id, text in rows:
        ids = np.array(_ids(text) + [1], "<u4")
        found.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return found


def test_ids_of_odd_texts():
    import pyarrow as pa

    for cached in (3, 600_000):
        for text, ids in zip(ODD, WordIds(VOCABULARY, cached).of_column(pa.array(ODD, pa.string()))):
            assert ids.tolist() == _ids(text), text


def test_whole_table(spark):
    found = [tuple(r) for r in queries.QUERIES["op11_arrow_sequences"](spark, SF001).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(found) == _expected(sorted(map(tuple, docs)))


@pytest.mark.parametrize("shape", [(1, 1, 1), (4, 2, 3), (16, 3, 6), (2048, 256, 1 << 16)])
def test_edge_rows(spark, edge_docs, shape):
    length, batch_rows, file_rows = shape
    if length == 1:
        edge_docs = edge_docs.where("doc_id <> 6")  # else 120,000 files
    elif length < 100:
        file_rows = 5000
    found = [tuple(r) for r in arrow_sequences.stored_documents(edge_docs, VOCABULARY, length, batch_rows, file_rows).collect()]
    rows = sorted(((r["doc_id"], r["text"]) for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(found, key=lambda r: r[1]) == _expected(rows)


def test_empty_table(spark, edge_docs):
    assert arrow_sequences.stored_documents(edge_docs.limit(0), VOCABULARY).collect() == []


def test_random_access_without_a_copy(spark, tmp_path):
    writer = SequenceWriter(f"file://{tmp_path}", 8, 4, 8, wide=False)
    rng, ids = np.random.default_rng(3), []
    for n in (1, 7, 8, 9, 31, 32, 33, 200, 1):
        ids.append(rng.integers(0, 49_408, n).astype(np.uint32))
        assert writer.add(ids[-1]) == sum(map(len, ids[:-1]))
    whole, seen = np.concatenate(ids), 0
    for number, first, tokens, path in writer.close():
        file = SequenceFile(path)
        assert first == seen == number * 64
        for i in range(len(file)):
            view, mask = file.sequence(i)
            assert len(view) == len(mask) == 8 and not view.flags.owndata
            assert np.array_equal(view[mask], whole[seen:seen + 8]) and not view[~mask].any()
            seen += int(mask.sum())
        assert seen == first + tokens
    assert seen == len(whole)


def test_index_lists_all_files(spark, documents):
    folder = scratch_path(spark, "sequences")
    index = arrow_sequences.write_sequences(documents, VOCABULARY, folder, 64, 8, 16).collect()
    files = [r for r in index if r["number"] is not None]
    assert sum(r["n_tokens"] for r in files) == sum(r["n_tokens"] for r in index if r["number"] is None)
    assert all(len(SequenceFile(r["file"])) == -(-r["n_tokens"] // 64) for r in files)
