"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, chat, fingerprint, packing, simhash, suffix_dedup, topk, toxicity, urls, wordpiece
from threadloom.llm.common import table


def vocab_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; THREADLOOM_VOCAB_DIR names another folder."""
    if folder := os.environ.get("THREADLOOM_VOCAB_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), vocab_path())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(*toxicity.labelled_sample(docs, labels, toxicity.learnable()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(~toxicity.learnable(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filter_captures(urls.dated_captures(pages), urls.dated_list(pages))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return topk.search(docs, docs.filter(F.col("doc_id") % 100 == 0), 10)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocab_path())


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocab_path())


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_counts, op2_toxicity, op3_merkle_fingerprints, op4_chat_formatting, op5_url_filters, op6_simhash_near_dedup, op7_topk_search, op8_best_fit_packing, op9_bpe_round_trip, op10_suffix_array_dedup]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_merkle_fingerprints": fingerprint.ORACLE, "op4_chat_formatting": chat.ORACLE, "op5_url_filters": urls.ORACLE, "op7_topk_search": topk.ORACLE}
