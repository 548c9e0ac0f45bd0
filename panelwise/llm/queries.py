"""Registered queries of the training-data operators.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLES`` has the
DuckDB text of those that SQL can express.  Each query applies its operator,
with production parameters, to its whole table.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import arrow_sequences, best_fit_packing, byte_cnn, cap_filters, flow_resharding, license_dice, order_minhash, periodic_runs, pii_surrogates, prefix_trie, quality_divergence, source_mixing, sql, warc_bundles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_distribution_divergence", sql.quality_sql())
def op1_distribution_divergence(spark, sf_dir):
    report = quality_divergence.divergence_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_low_discrepancy_mix", sql.mixing_sql())
def op5_low_discrepancy_mix(spark, sf_dir):
    mix = source_mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_flow_resharding")
def op10_flow_resharding(spark, sf_dir):
    return flow_resharding.sharded_report(table(spark, sf_dir, "documents"))


@query("op4_seekable_warc", sql.WARC)
def op4_seekable_warc(spark, sf_dir):
    return warc_bundles.archived_pages(table(spark, sf_dir, "pages"))


@query("op9_spherical_cap_filters")
def op9_spherical_cap_filters(spark, sf_dir):
    return cap_filters.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_order_minhash")
def op6_order_minhash(spark, sf_dir):
    return order_minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query("op3_pii_surrogates")
def op3_pii_surrogates(spark, sf_dir):
    found = pii_surrogates.replace_entities(table(spark, sf_dir, "documents"), key="panelwise-demo-key")
    return found.select("doc_id", "text", F.col("_n_entities").alias("n_entities"))


@query("op7_byte_cnn")
def op7_byte_cnn(spark, sf_dir):
    return byte_cnn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_license_dice")
def op8_license_dice(spark, sf_dir):
    return license_dice.scan_documents(table(spark, sf_dir, "documents"))


@query("op11_arrow_sequences")
def op11_arrow_sequences(spark, sf_dir):
    import public_tokenizers

    return arrow_sequences.stored_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.run_report(table(spark, sf_dir, "documents"), edit=periodic_runs.planted_period)


@query("op12_prefix_trie")
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie_report(table(spark, sf_dir, "conversations"))
