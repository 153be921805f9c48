"""Rows judged by their own text, and scores that do not depend on how the index is cut."""

import random

import pytest
from pyspark.sql import functions as F

from saleslens.llm import decontaminate, toxicity


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def items():
    rng = random.Random(8)
    common = [prose(rng, 1) for _ in range(30)]
    return [(i, " ".join(rng.choice(common) if rng.random() < 0.4 else prose(rng, 1) for _ in range(rng.choice([20, 50, 300])))) for i in range(40)]


def test_shards_give_the_rows_of_one_index(spark, items):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(40)] + [f"{prose(rng, 9)} {t} {prose(rng, 9)}" for _, t in items[::3]]
    texts += [" ".join(t.split()[:len(t.split()) // 2 + 6]) for _, t in items[::4]] + [" ".join(t for _, t in items) * 3]
    docs = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string")
    bench = spark.createDataFrame(items + items[:5], "item_id long, text string")
    whole = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}
    cut = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench, shard_words=100).collect()}
    assert len(whole) > 40 and set(whole) == set(cut)
    for k, r in whole.items():
        assert cut[k].score == pytest.approx(r.score) and cut[k].question_overlap == r.question_overlap and cut[k].answer_overlap == r.answer_overlap
    assert len(list(decontaminate.indexes(bench, 100))) > 10
    clean = decontaminate.without_test_items(docs, bench, shard_words=500)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in whole}


def test_a_third_without_id_and_a_third_with_one(spark, items):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        bad = i % 4 == 0
        text = f"{prose(rng, 6)} {items[i % 40][1]}" if bad else prose(rng, 40)
        rows.append((None if i % 3 == 0 else 7 if i % 3 == 1 else i, text, bad))
    rows += [(5, None, False), (None, "", False)] + [rows[1]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad boolean").withColumns({c: F.lit("x") for c in ("__bad_id", "item_id", "score")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.without_test_items(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if not r.bad)


def test_toxic_rows_go_and_others_stay(spark):
    rng = random.Random(4)
    insults = ["idiotic", "moronic", "stupidly", "trashy"]
    rows = [(None if i % 3 == 0 else 9 if i % 3 == 1 else i, f"{prose(rng, 30)} {' '.join(insults) if i % 4 == 0 else ''}", i % 4 == 0) for i in range(200)]
    rows += [(None, None, False), (9, "", False)]
    train = [(1000 + i, f"{prose(rng, 30)} {' '.join(rng.sample(insults, 3)) if i % 2 else ''}") for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(train, "doc_id long, text string"),
                         spark.createDataFrame([(1000 + i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad boolean").withColumns({c: F.lit(1) for c in ("toxic", "severity", "__bad_id")})
    kept = toxicity.below(docs, model)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if not r.bad)


def test_shards_are_fair_without_ids_and_with_repeated_ones(spark):
    from saleslens.llm import sharding

    text = F.when(F.col("id") % 3 < 2, F.repeat(F.lit("x"), 300)).otherwise(F.repeat(F.lit("y"), (F.col("id") % 89).cast("int")))
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 5).otherwise(F.col("id")).alias("doc_id"), text.alias("text"))
    rows = sharding.shard(docs.repartition(6), 8)
    sums = rows.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    load = [r.b for r in sums]
    assert len(load) == 8 and max(load) - min(load) <= 0.01 * min(load)
    assert all(r.n == r.d == r.m + 1 for r in sums) and sum(r.n for r in sums) == 30_000
    assert rows.groupBy("virtual_slot").count().agg(F.max("count")).first()[0] < 30


def test_the_sample_is_bounded_after_the_join(spark):
    docs = spark.range(9000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).union(
        spark.range(500).select(F.lit(1).cast("long"), F.lit("the same text")))
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    sizes = {r.y: r["count"] for r in toxicity.labelled_sample(docs, labels, "toxic", 100).groupBy("y").count().collect()}
    assert 60 < sizes[0] < 150 and 60 < sizes[1] < 150
    whole = toxicity.labelled_sample(docs.filter("doc_id = 1"), labels, "toxic", 10_000)
    assert whole.count() == 3001 and whole.filter("text = 'the same text'").count() == 1


def test_repeated_vector_ids_give_the_smallest_vector(spark):
    from saleslens.llm import ann

    rows = [(20, [3.0, 1.0]), (20, [1.0, 5.0]), (20, [1.0, 4.0]), (40, [1.0, 4.0]), (7, [0.0, 2.0]), (8, [2.0, 2.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    want = None
    for tasks in (1, 5):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(tasks)
        got = sorted(map(tuple, ann.nearest(table, k=5).collect()))
        assert want is None or got == want
        want = got
    assert {(q, v, s) for q, _, v, s in want} == {(20, 40, 17.0), (20, 8, 10.0), (20, 7, 8.0), (40, 20, 17.0), (40, 8, 10.0), (40, 7, 8.0)}
