"""The operators of this folder over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm import (
    chat_format, exact_dedup, host_rules, lm_score, merkle, mixing, packing, periodic, quality, secret_scan, sharding, simhash, url_lists,
)
from rankforge.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_schema_fingerprints", chat_format.SQL)
def op1_schema_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    records = chat_format.turn_records(table(spark, folder, "conversations")).unionByName(chat_format.probe_records(spark))
    return chat_format.digests(chat_format.format_records(records))


@query("op2_golay_simhash")
def op2_golay_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


@query("op3_host_rules", host_rules.SQL)
def op3_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return host_rules.judge_documents(table(spark, folder, "documents"))


@query("op4_weighted_fair_mix", mixing.SQL)
def op4_weighted_fair_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.weighted_fair_mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_block_naming", exact_dedup.SQL)
def op5_block_naming(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op6_temporal_lists", url_lists.SQL)
def op6_temporal_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_lists.judge_captures(url_lists.dated_captures(pages), url_lists.list_of_hosts(pages))


@query("op7_concatenate_and_cut")
def op7_concatenate_and_cut(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(packing.TOKENIZER), with_ids=False)


@query("op8_naive_bayes_svm")
def op8_naive_bayes_svm(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_deleted_interpolation")
def op9_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score_documents(table(spark, folder, "documents"))


@query("op10_guess_cost")
def op10_guess_cost(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


@query("op11_hash_tree", sharding.SQL)
def op11_hash_tree(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"))


@query("op12_merkle_descent", merkle.SQL)
def op12_merkle_descent(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verify(table(spark, folder, "documents"))


@query("op13_maximal_pairs")
def op13_maximal_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_digests(periodic.find_runs(periodic.planted(table(spark, folder, "documents"))))
