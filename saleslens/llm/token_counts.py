"""Token counts through a cache of digests.

A text is normalised (runs of white space become one space), and the digest of the normalised text
together with the digest of the tokenizer file is its key in a stored table of counts. Texts are
joined to that table; the distinct ones it lacks are encoded once each and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.llm.common import text_or_empty, worker_memo

CACHE = "digest binary, n_tokens long"
#: Words whose counts a worker remembers; the memory it may take, not a limit of what is counted.
REMEMBERED = 400_000


def version(path: str) -> str:
    """Digest of a tokenizer file: counts of one version are never taken for those of another."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def normalised(text: Column) -> Column:
    """Texts that differ in white space only count the same, as the tokenizer drops it."""
    return F.trim(F.regexp_replace(text, r"[\t-\r ]+", " "))


def digest(text: Column, tokenizer_version: str) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(tokenizer_version + "\n"), normalised(text)), 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each digest in a task; at most one row of a group of copies leaves it."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d[:12] not in seen:
                seen.add(d[:12])
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int32()))


def counter(tokenizer_json: str):
    """A function of Arrow batches (digest, text) to (digest, n_tokens), one row for each digest.

    White space separates words for this tokenizer before anything else, and so the count of a text
    is the sum over its words. The library encodes each word that the worker does not remember.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        held = worker_memo("tokenizers")
        key = hash(tokenizer_json)
        if key not in held:
            held[key] = (Tokenizer.from_str(tokenizer_json), {})
            held[key][0].no_truncation()
            held[key][0].no_padding()
        tokenizer, known = held[key]
        seen: set[bytes] = set()
        for batch in batches:
            keys, sums = [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if d[:16] in seen:
                    continue
                seen.add(d[:16])
                words = text.as_py().split(" ")
                missing = [w for w in set(words) if w not in known]
                if missing:
                    if len(known) > REMEMBERED:
                        known.clear()
                        missing = list(set(words))
                    for lo in range(0, len(missing), 4096):
                        part = missing[lo:lo + 4096]
                        for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                            known[w] = len(e.ids)
                keys.append(d)
                sums.append(sum(map(known.__getitem__, words)))
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(sums, pa.int64())], names=["digest", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    ``tokenizer`` is the path of a tokenizer file whose words end at white space, ``cache`` the
    folder of the stored counts. Null texts count as empty, which has no token; repeated rows stay
    repeated; an empty table gives none. The texts of misses are reduced to one of each digest in
    every task before they are dealt by digest, so that a group of copies sends a row for a task.
    """
    spark = docs.sparkSession
    tokenizer_version = version(tokenizer)
    text = text_or_empty()
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest(text, tokenizer_version).alias("digest"))
    have = read_cache(spark, cache)
    texts = docs.select(digest(text, tokenizer_version).alias("digest"), normalised(text).alias("text"))
    misses = texts.join(have.select("digest"), "digest", "left_anti") if have.head(1) else texts
    misses = misses.mapInArrow(first_of_each, "digest binary, text string")
    counted = misses.repartition("digest").mapInArrow(counter(Path(tokenizer).read_text("utf-8")), CACHE)
    counted.write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache)
    return (keyed.join(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
