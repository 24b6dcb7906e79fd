"""Registered queries of the operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import align, bpe, chat, counts, decontaminate, factors, neardup, ngrams, pages, runs, sketch, sql, suffixes, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_suffix_array_dedup(spark, folder):
    out = suffixes.remove_repeated_bytes(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op5_substring_dedup(spark, folder):
    out = factors.remove_repeated_words(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op4_minhash_near_dedup(spark, folder):
    return neardup.near_duplicate_ids(table(spark, folder, "documents").select("doc_id", "text"), size=4)


@query
def op10_bpe_encoding_and_decoding(spark, folder):
    out = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op1_document_fingerprints(spark, folder):
    out = sketch.fingerprint(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op9_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    out = ngrams.judge(docs, table(spark, folder, "labels"), with_text=False)
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "deviation", "kept")


@query
def op2_benchmark_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, folder, "benchmark"))


@query
def op7_chat_formatting(spark, folder):
    told = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(turns.unionByName(more), lookback=0).drop("rewrites_history")


@query
def op8_url_filters(spark, folder):
    out = urls.judge(table(spark, folder, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "host", "path", "rule", "verdict")


ORACLE["op8_url_filters"] = urls.SQL


@query
def op11_token_counts(spark, folder):
    out = counts.count_tokens(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op12_periodic_run_detection(spark, folder):
    out = runs.run_digests(runs.planted(table(spark, folder, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query
def op13_cross_tokenizer_alignment(spark, folder):
    out = align.linked(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op6_html_extraction(spark, folder):
    out = pages.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")


ORACLE["op4_minhash_near_dedup"] = sql.NEAR_DUPLICATES
ORACLE["op5_substring_dedup"] = sql.REPEATED_WORDS
ORACLE["op7_chat_formatting"] = sql.CHAT
