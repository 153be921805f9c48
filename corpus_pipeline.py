"""A training-data pipeline: toxicity, near-duplicates, repeated passages, test items, encoding.

Each stage takes the documents that its predecessor kept. Stages hand over the columns of
``documents`` (doc_id, text, lang, source, n_chars, and whatever else the table has); the last one
returns the encoded documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.llm import byte_bpe, decontaminate, simhash, substring_dedup, toxicity
from saleslens.llm.common import row_digest, stored, table

#: Words that a text must keep after removal of repeats, unless nothing was removed from it.
LEAST_WORDS = 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents of the table and keeps the rows below the severity to reject.

    Each row is judged by its own text, also without id or with the id of another; null texts are empty.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.below(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near-duplicates: that with the smallest id, rows without id last."""
    return simhash.one_of_each(docs)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, ``__row``, in the order of their ids; rows without id come last, equal ids in the order of a digest.

    Numbers are ids themselves where these are whole numbers and each row has its own.
    """
    if docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") and not (
            docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").head(1)):
        return docs.withColumn("__row", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), *row_digest(docs, ["doc_id", "text"]), *row_digest(docs, docs.columns)]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(docs.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; a document of which nothing is left goes. n_chars follows the text.

    Every row is a document of its own, also without id or with the id of another.
    """
    rows = numbered(docs)
    kept = substring_dedup.remove_repeats(rows.select(F.col("__row").alias("doc_id"), "text"), texts=True).filter(
        "n_removed > 0").select(F.col("doc_id").alias("__cut_id"), F.col("kept").alias("__kept"), (F.col("n_words") - F.col("n_removed")).alias("__left"))
    joined = rows.join(kept, rows["__row"] == kept["__cut_id"], "left").filter(F.col("__left").isNull() | (F.col("__left") >= LEAST_WORDS))
    text = F.when(F.col("__cut_id").isNotNull(), F.col("__kept")).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__cut_id").isNotNull(), F.length("__kept").cast("long")).otherwise(F.col("n_chars"))
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows in whose text no benchmark item is found, whatever their id; null texts are empty and stay."""
    return decontaminate.without_test_items(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes of every row; null texts are empty, ids are handed through."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_test_items),
    ("byte_bpe", encode),
]
#: Models, hashes and automata can't be stated in SQL; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
