import numpy as np
import pytest
from pyspark.sql import functions as F

from saleslens.operators import evaluation as E
from saleslens.operators import ranks as R


@pytest.mark.parametrize("per_bucket", [10_000, 7])
def test_quantiles_match_numpy(spark, per_bucket):
    values = np.round(np.random.default_rng(3).exponential(100, 900), 1)
    groups = ["a" if i % 3 else None for i in range(900)]
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, values)], "g string, v double")
    quantiles = {"q0": 0.0, "q1": 0.01, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = {r["g"]: r for r in R.exact_quantiles(df, "v", quantiles, ["g"], rows_per_bucket=per_bucket).collect()}
    for g in ("a", None):
        own = [v for k, v in zip(groups, values) if k == g]
        for name, q in quantiles.items():
            assert got[g][name] == pytest.approx(np.quantile(own, q))


def test_running_totals_over_buckets(spark):
    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(500)], "v int, n int")
    marked = R.bucket_by_value(df, "v", rows_per_bucket=20)
    assert marked.select(R.BUCKET).distinct().count() > 10
    got = R.running_totals(marked, {"upto": "n"}, [F.col("v")]).orderBy("v").collect()
    assert [r["upto"] for r in got] == list(np.cumsum([(i * 37) % 11 for i in range(500)]))
    down = R.running_totals(marked, {"upto": "n"}, [F.desc("v")], bucket_order="desc").orderBy(F.desc("v")).collect()
    assert [r["upto"] for r in down] == list(np.cumsum([(i * 37) % 11 for i in range(499, -1, -1)]))


def test_small_buckets_are_no_tasks_of_their_own(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit(1).alias("n"))
    marked = R.bucket_by_value(df, "v", rows_per_bucket=10)
    assert marked.select(R.BUCKET).distinct().count() >= 500
    assert len(marked.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = sorted(map(tuple, marked.groupBy(R.BUCKET).agg(F.min("v"), F.max("v"), F.count("*")).collect()))
    assert all(n <= 10 for *_, n in spans) and all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert [tuple(r) for r in R.exact_quantiles(df, "v", {"m": 0.5}).collect()] == [(None,)]


def test_split_and_folds_are_balanced(spark):
    df = spark.range(3001).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    split = E.stratified_split(df, "k")
    for label, total in ((1, 429), (0, 2572)):
        assert split.where(f"label = {label} AND is_test").count() == int(total * 0.3 + 0.5)
    sizes = E.stratified_folds(df, "k").groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert split.count() == 3001
    again = E.stratified_split(df.repartition(7), "k")
    assert split.where("is_test").exceptAll(again.where("is_test")).isEmpty()


def test_no_window_without_partition(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("label"))
    plan = E.stratified_folds(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan


def test_sketches_merge_and_keep_their_error(spark):
    from saleslens.operators import ranks as K

    df = spark.range(40000).select((F.col("id") * 7919 % 40000).cast("double").alias("x"), (F.col("id") % 9).alias("day"), (F.col("id") % 2).alias("g"))
    fractions = {"low": 0.1, "mid": 0.5, "high": 0.95}
    merged = K.merged_sketches(K.quantile_sketch(df, "x", ["g", "day"]), ["g"])
    for r in K.sketched_quantiles(merged, fractions).collect():
        for name, q in fractions.items():
            below = df.where((F.col("g") == r["g"]) & (F.col("x") <= r[name])).count() / 20000
            assert abs(below - q) < 0.0266
    nothing = K.quantile_sketch(df.withColumn("x", F.lit(None).cast("double")).limit(5), "x")
    assert K.sketched_quantiles(nothing, fractions).first()["mid"] is None
