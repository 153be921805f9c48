"""Registered queries of the operators on large text, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.llm import (ann, byte_bpe, collocations, decontaminate, filter_audit, html_extract, quality, sharding,
                           simhash, substring_dedup, token_counts, token_files, toxicity)
from saleslens.llm.common import table
from saleslens.session import scratch

SHARDS = 40
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Most of these operators can't be stated in the SQL of the comparison: hashes, automata, models and
#: tokenizers are missing there. Tests compare those with brute force.
SQL: dict[str, str] = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot map is stored as a versioned table and edited until the bytes of the shards are near equal."""
    docs = table(spark, sf_dir, "documents")
    laid = sharding.shard(docs, SHARDS, scratch(spark))
    return laid.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold test items, one row for each document and item."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded in this call."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch(spark))


@query("op7_html_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op10_nearest")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query("op11_filter_audit")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op11_filter_audit"] = filter_audit.SQL


@query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the files and reads every document back from them."""
    folder = scratch(spark)
    files = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.digests(files, folder)


@query("op13_collocations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op13_collocations"] = collocations.SQL


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
