"""Corpus pipeline: the stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared folder and reread as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwise.llm import best_fit_packing, order_minhash, pii_surrogates, quality_divergence, source_mixing
from panelwise.llm.shared import dropped, scratch_path, scratch_scope, written_at

#: Of the surrogates; a deployment passes its own.
SURROGATE_KEY = "panelwise-demo-key"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts go; repeated rows are judged alike and stay
    each; a null language or source is one like others; no rows give none.
    """
    return quality_divergence.keep_close_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies.

    Equal texts are copies, empty ones too; of equal rows one stays; an id
    with several texts is judged by each of them; rows with a null id or text
    stay; no rows give none.
    """
    return order_minhash.without_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates.

    Null and empty texts stay as they are; equal texts are changed alike, a
    row each; no rows give none.
    """
    return pii_surrogates.replace_entities(docs, SURROGATE_KEY).drop("_n_entities")


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null, empty and blank texts have no word to take and go; repeated rows are
    documents each; a null source is one like others; no rows give none.
    """
    return source_mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and offset.

    A null or empty text is one piece of the end id; repeated rows are packed
    each; no rows give none.
    """
    import public_tokenizers

    return best_fit_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("source_weights", source_weights), ("packed", packed)]

#: Tokenisation has no SQL; tests/llm compares each stage with a brute-force version on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to all of ``documents``; all tables but the result's are deleted on the way."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            docs = written_at(stage(spark, docs, sf_dir), path)
        if before:
            dropped(spark, before)
        before = path
    return docs
