"""The pipeline against the same decisions made one by one."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saleslens.llm import byte_bpe, simhash
from saleslens.session import scratch


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(21)
    items = [(i, prose(rng, 30)) for i in range(5)]
    passage = prose(rng, 70)
    texts = [prose(rng, rng.randint(40, 90)) for _ in range(120)]
    for i in range(0, 120, 6):
        texts[i] += " vileword " + prose(rng, 3)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(4)]
    texts += [f"{prose(rng, 25)} {t} {prose(rng, 25)}" for _, t in items]
    texts += [texts[1], texts[2], None, "", texts[3].replace(" ", "\n", 3)]
    path = scratch(spark)
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)],
                          "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, items, passage


def test_pipeline_against_plain_decisions(spark, folder):
    path, texts, items, passage = folder
    kept = {i: t for i, t in enumerate(texts) if "vileword" not in (t or "")}
    seen = {}
    for i in sorted(kept):
        seen.setdefault(simhash.fingerprint((kept[i] or "").encode()), i)
    kept = {i: kept[i] for i in seen.values()}
    windows = set()
    for i in sorted(kept):
        words = (kept[i] or "").split()
        gone = [False] * len(words)
        for j in range(len(words) - 19):
            key = tuple(words[j:j + 20])
            if key in windows:
                gone[j:j + 20] = [True] * 20
            windows.add(key)
        if any(gone):
            kept[i] = " ".join(w for w, g in zip(words, gone) if not g)
    assert sum(passage in (t or "") for t in kept.values()) == 1
    kept = {i: t for i, t in kept.items() if not any(x in re.sub(r"\s+", " ", t or "") for _, x in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert sorted(got) == sorted(kept)
    for i, r in got.items():
        assert r.decoded_sha256 == hashlib.sha256((kept[i] or "").encode()).hexdigest()
    ids = byte_bpe.encode(spark.createDataFrame(list(kept.items()), "doc_id long, text string"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {r.doc_id: len(r.ids) for r in ids.collect()} == {i: r.n_tokens for i, r in got.items()}


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), path)
        assert out.columns == docs.columns and out.count() == 0
    clash = docs.withColumn("__cut_id", F.lit(1)).limit(5)
    assert corpus_pipeline.drop_test_items(spark, clash, path).count() <= 5
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "byte_bpe"]


def test_rows_without_and_with_repeated_ids(spark, folder):
    path, _, items, _ = folder
    rng = random.Random(33)
    passage = prose(rng, 60)
    own = [prose(rng, 50) for _ in range(8)]
    rows = [(1, own[0]), (1, own[1]), (None, own[2]), (None, own[3]), (None, own[3]), (None, own[0]), (2, own[4]), (2, own[4]), (3, own[4]),
            (5, f"{own[5]} {passage}"), (5, f"{own[6]} {passage}"), (None, f"{own[7]} {passage}"), (None, own[7])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    once = corpus_pipeline.drop_near_duplicates(spark, docs, path)
    want = sorted([(1, own[0]), (1, own[1]), (None, own[2]), (None, own[3]), (2, own[4]), *rows[9:]], key=str)
    assert sorted(((r.doc_id, r.text) for r in once.collect()), key=str) == want and once.columns == docs.columns
    cut = corpus_pipeline.cut_repeats(spark, once, path)
    assert cut.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in cut.collect()), key=str)
    plain = [(i, t) for i, t in want if passage not in t and t != own[7]]
    assert [(i, t) for i, t, _ in got if (i, t) in plain] == plain
    rest = [x[:2] for x in got if x[:2] not in plain]
    # the first of the rows with id 5 keeps the passage; of the two rows without id one keeps the text that both have
    assert sorted(t for i, t in rest if i == 5) in (sorted([own[5], rows[10][1]]), sorted([own[6], rows[9][1]]))
    assert [t for i, t in rest if i is None] == [own[7]] and all(n == len(t) for _, t, n in got)
    again = docs.limit(0).union(docs.filter("doc_id is null and text = '" + own[3] + "'"))
    assert corpus_pipeline.drop_near_duplicates(spark, again, path).count() == 1
    assert corpus_pipeline.drop_near_duplicates(spark, docs.withColumn("doc_id", F.lit(None).cast("long")), path).count() == len({t for _, t in rows})
