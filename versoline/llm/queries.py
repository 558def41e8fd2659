"""The registered queries of this subpackage: each applies one operator, as it would run in production, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from versoline.llm import bpe, conversations, infill, licences, maxent, near_dups, ordering, packing, perplexity, quality, suffixes, topk, toxicity
from versoline.llm.shared import bound_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound_batches(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_quality_rules")
def op1_quality_rules(table) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity and its bands."""
    return perplexity.perplexity(table("documents"))


@query("op2_quality_classifier")
def op2_quality_classifier(table) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept."""
    return quality.quality(table("documents"), table("labels"))


@query("op3_training_order")
def op3_training_order(table) -> DataFrame:
    """slot, shard, byte_offset, doc_id, seq, n_tokens, ids_crc32 of every record, read from the shards."""
    return ordering.listing(ordering.shards(table("documents")))


@query("op4_byte_bpe")
def op4_byte_bpe(table) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(table("documents"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(table) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(table("documents"))


@query("op6_exact_top_k", topk.ORACLE)
def op6_exact_top_k(table) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return topk.search(table("embeddings"))


@query("op7_licence_scan", licences.oracle())
def op7_licence_scan(table) -> DataFrame:
    """doc_id, n_sentences, licences, matched."""
    return licences.scan(table("documents"))


@query("op8_minhash_near_dedup")
def op8_minhash_near_dedup(table) -> DataFrame:
    """doc_id, class_id, n_links."""
    return near_dups.near_duplicates(table("documents")).select("doc_id", "class_id", "n_links")


@query("op9_toxicity")
def op9_toxicity(table) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return toxicity.toxicity(table("documents"), table("labels"))


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(table) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return suffixes.repeats(table("documents"))


@query("op11_conversation_repair", conversations.ORACLE)
def op11_conversation_repair(table) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return conversations.damaged_and_repaired(table("conversations"))


@query("op12_fill_in_middle", infill.ORACLE)
def op12_fill_in_middle(table) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return infill.digests(table("documents"))


@query("op13_lm_scoring")
def op13_lm_scoring(table) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return maxent.scores(table("documents"))
