import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.functions import age_band, amount_edges, amount_labels, epoch, income_lower_bound, series_name
from saleslens.operators import cleaning as C
from saleslens.operators import encode as E
from saleslens.operators import profile as R
from saleslens.sources import tables as IO


def test_age_bands(spark):
    ages = [17, 18, 24, 25, 38, 45, 50, 51, 70, 71, None]
    got = spark.createDataFrame([(a,) for a in ages], "age int").select(age_band("age")).collect()
    assert [r[0] for r in got] == [None, "18–24", "18–24", "25–31", "39–45", "46–52", "46–52", "53–59", "67–70", None, None]


def test_amount_bins():
    edges = amount_edges()
    assert len(edges) == 12 and edges[0] == 5.17 and edges[-1] == 1989.25
    assert amount_labels(edges)[0] == "5–186" and amount_labels(edges)[-1] == "1809–1989"


@pytest.mark.parametrize("text,plain,thousands", [
    ("30k-50k", 3000.0, 30000.0), ("3000-5000", 3000.0, 3000.0), ("$1,200", 1200.0, 1200.0), ("30k", 30000.0, 30000.0),
    ("30K", 30000.0, 30000.0), ("150k+", 3000.0, 3000.0), ("", 3000.0, 3000.0), (None, 3000.0, 3000.0), ("abc", 3000.0, 3000.0)])
def test_income_texts(spark, text, plain, thousands):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(income_lower_bound("t"), income_lower_bound("t", read_thousands=True)).first()
    assert (row[0], row[1]) == (plain, thousands)


def test_epoch_and_names(spark):
    df = spark.createDataFrame([(dt.date(2021, 6, 1), "not_interested"), (None, None)], "d date, o string")
    got = df.select(epoch("d"), epoch("d", "ns"), series_name("o")).collect()
    assert tuple(got[0]) == (1622505600, 1622505600000000000, "Not Interested") and tuple(got[1]) == (None, None, None)


def test_dates_are_judged_on_all_rows(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01", None), (None, "x", None)], "good string, bad string, none string")
    assert C.date_like_columns(df) == ["good"]
    assert [r["bad"] is None for r in C.coerce_dates(df, ["bad"]).collect()] == [False, True]


def test_continuous_columns(spark):
    df = spark.range(100).select("id", (F.col("id") % 10).alias("ten"), (F.col("id") % 11).alias("eleven"),
                                 F.col("id").alias("Unnamed: 0"), F.col("id").cast("string").alias("text"))
    assert C.continuous_columns(df) == ["id", "eleven"]


def test_alignment(spark):
    df = spark.createDataFrame([("a", 1, 2)], "user_id string, x int, z int")
    assert C.schema_differences(df.drop("user_id"), ["x", "y"]) == {"missing": ["y"], "extra": ["z"]}
    assert C.align_columns(df, ["y", "x"], ["user_id"]).first().asDict() == {"user_id": "a", "y": 0, "x": 1}


def test_multi_select_with_missing_values(spark):
    df = spark.createDataFrame([(1, None), (2, "high"), (3, "low")], "id int, p string")
    assert [r["id"] for r in C.any_of(df, {"p": ["high", ""]}).orderBy("id").collect()] == [1, 2]
    assert C.any_of(df, {"p": []}).count() == 3 and C.any_of(df, {"p": None}).count() == 3


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select("id", F.timestamp_seconds("id").alias("t"), F.lit("x").alias("unused")).write.parquet(f"{tmp_path}/t")
    df = C.between_dates(spark.read.parquet(f"{tmp_path}/t"), "t", "1970-01-01", "1970-01-02").select("id", "t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t" in plan and "LessThanOrEqual(t" in plan and "unused" not in plan


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, None)], "x double, same double")
    got = E.StandardScaler.fit(df, ["x", "same"]).transform(df).collect()
    sd = np.std([1, 2, 6])
    assert got[0]["x"] == pytest.approx((1 - 3) / sd) and got[0]["same"] == 0.0 and got[2]["same"] is None


def test_label_codes_follow_bytes(spark):
    df = spark.createDataFrame([("b",), ("Z",), ("á",), (None,), ("b",)], "c string")
    coder = E.LabelEncoder.fit(df, ["c"])
    assert [r["c"] for r in coder.transform(df).collect()] == [1, 0, 3, 2, 1]
    unseen = spark.createDataFrame([("new",)], "c string")
    assert coder.transform(unseen).first()["c"] is None


def test_long_dictionaries_give_the_same_codes(spark):
    df = spark.range(700).select(F.concat(F.lit("señor "), (F.col("id") * 37 % 301).cast("string")).alias("c"))
    coder = E.LabelEncoder.fit(df, ["c"])
    words = sorted({f"señor {i * 37 % 301}" for i in range(700)}, key=lambda s: s.encode())
    got = coder.transform(df.withColumn("was", F.col("c"))).collect()
    assert all(words[r["c"]] == r["was"] for r in got) and len(got) == 700


def test_winsorizer(spark):
    values = [float(v) for v in range(200)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["x"] for r in E.Winsorizer.fit(df, ["x"]).transform(df).collect()]
    low, high = np.quantile(values[:200], [0.01, 0.99])
    assert min(v for v in got if v is not None) == pytest.approx(low) and got[-1] is None
    assert max(v for v in got if v is not None) == pytest.approx(high)


def test_one_hot_drops_the_first(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    got = E.OneHot.fit(df, ["c"]).transform(df)
    assert got.columns == ["c_b"] and [r["c_b"] for r in got.collect()] == [True, False, False]


def test_log1p_where_undefined(spark):
    got = E.log1p(spark.createDataFrame([(0.0,), (-2.0,)], "x double"), ["x", "y"]).collect()
    assert got[0]["x"] == 0.0 and got[1]["x"] is None


def test_inflation_factors_match_regressions(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(5, 1, 400), rng.normal(0, 2, 400)
    c = a * 2 + b + rng.normal(0, 0.5, 400)
    x = np.column_stack([a, b, c])
    df = spark.createDataFrame(x.tolist() + [[None, 1.0, 1.0]], "a double, b double, c double")
    got = {r["variable"]: r["vif"] for r in R.variance_inflation(df, ["a", "b", "c"]).collect()}
    full = np.column_stack([np.ones(400), x])
    for i, name in enumerate(["const", "a", "b", "c"]):
        y, others = full[:, i], np.delete(full, i, 1)
        rest = y - others @ np.linalg.lstsq(others, y, rcond=None)[0]
        total = y @ y if name == "const" else ((y - y.mean()) ** 2).sum()
        assert got[name] == pytest.approx(total / (rest @ rest), rel=1e-6)
    correlations = {(r["variable_x"], r["variable_y"]): r["correlacion"] for r in R.correlation(df, ["a", "b", "c"]).collect()}
    assert correlations[("c", "a")] == pytest.approx(np.corrcoef(x.T)[0, 2], rel=1e-6) and len(correlations) == 9


def test_contingency_totals(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x"), ("b", "z")], "r string, c string")
    got = {r["r"]: r.asDict() for r in R.contingency(df, "r", "c", ["x", "y"], totals=True).collect()}
    assert got["Total"] == {"r": "Total", "x": 2, "y": 1, "Total": 4} and got["NA"]["x"] == 1 and got["b"]["Total"] == 1


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("u1", "credit_card", dt.date(2021, 1, 2)), ("u2", None, None)], S.PRODUCTS)
    IO.write_csv(df.select("product_type", "contract_date", "user_id"), f"{tmp_path}/p.csv")
    back = IO.read_csv(spark, f"{tmp_path}/p.csv", S.PRODUCTS)
    assert back.columns == S.PRODUCTS.names and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert IO.read_csv_without(spark, f"{tmp_path}/p.csv", S.PRODUCTS, ["contract_date", "nope"]).columns == ["user_id", "product_type"]


def test_split_sink_and_audit(spark, tmp_path):
    df = spark.createDataFrame([("u1", 1.5, True)], "user_id string, x double, insurance boolean")
    IO.write_split(df, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/X").columns == ["user_id", "x"]
    assert spark.read.parquet(f"{tmp_path}/y").columns == ["user_id", "insurance"]
    df.createOrReplaceTempView("goals")
    report = {r["tabla"]: (r["presente"], r["filas"]) for r in IO.audit_catalog(spark).collect()}
    assert report["goals"] == (True, 1) and report["contacts"] == (False, None)
    spark.catalog.dropTempView("goals")
    assert IO.empty_tables({"a": df, "b": df.limit(0)}) == ["b"]


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("string").alias("user_id"), "id")
    for name in ("left_side", "right_side"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        IO.write_bucketed(df, name, buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("left_side").join(spark.table("right_side"), "user_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in ("left_side", "right_side"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_univariate(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 3, 3, None)], "v int")
    got = R.univariate(df, "v").first()
    assert (got["moda"], got["mediana"], got["minimo"], got["maximo"]) == (2, 2.0, 1, 3)
    assert got["varianza"] == pytest.approx(0.7) and got["desviacion"] == pytest.approx(math.sqrt(0.7))
    nulls = {r["columna"]: r["nulos"] for r in R.columns_with_nulls(df).collect()}
    assert nulls == {"v": 1}


def test_inflation_of_dependent_columns(spark):
    df = spark.range(500).repartition(40).select(
        (F.rand(1) + 1e6).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"), F.lit(3.0).alias("k"), F.lit(0.0).alias("zero"))
    df = df.withColumns({"ab": F.col("a") * 2 - F.col("b"), "missing": F.lit(None).cast("double")}).cache()

    def factors(columns, rows=df):
        return {r["variable"]: r["vif"] for r in R.variance_inflation(rows, columns).collect()}

    got = factors(["a", "b", "c", "ab"])
    assert got["a"] == got["b"] == got["ab"] == float("inf") and 1 <= got["c"] < 1.1 and got["const"] < float("inf")
    got = factors(["b", "c", "k"])
    assert got["k"] is None and got["const"] == float("inf") and 1 <= got["b"] < 1.1
    got = factors(["b", "c", "zero"])
    assert got["zero"] is None and 1 < got["const"] < 20
    assert set(factors(["a", "b"], df.limit(0)).values()) == {None}
    assert set(factors(["b", "missing"]).values()) == {None}
    assert factors(["b"], df.limit(1))["b"] is None
    assert factors(["b", "c"], df.withColumns({"c": 1 - F.col("b")}))["b"] == float("inf")


def test_triangle_keeps_the_digits(spark):
    """Columns of size 1e8 that differ by 1e-4: their covariance has lost that, the triangle has not."""
    import numpy as np

    from saleslens.operators.factoring import inflation, triangle

    rng = np.random.default_rng(0)
    x, y = rng.random(400), rng.random(400)
    df = spark.createDataFrame([(1e8 + float(a), 1e8 + float(a) + 1e-4 * float(b)) for a, b in zip(x, y)], "p double, q double").repartition(20)
    (p, q), _ = inflation(*triangle(df, ["p", "q"]))
    rows = np.array(df.collect()) - 1e8
    exact = 1 / (1 - np.corrcoef(rows.T)[0, 1] ** 2)
    assert p == pytest.approx(exact, rel=0.05) and q == pytest.approx(p)


def test_profiles_read_the_table_once(spark, tmp_path):
    """What a profile has left to run once its counts are written reads no row of the table."""
    spark.range(200).select((F.col("id") % 7).alias("g"), (F.col("id") % 50 / 4).alias("x"), F.col("id").alias("y")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for build in (lambda: R.univariate(table, "x"), lambda: R.describe(table, ["x", "y"]), lambda: R.group_median(table, "g", "x"), lambda: R.grouped_stats(table, "g", "x")):
        plan = build()._jdf.queryExecution().executedPlan().toString()
        assert f"{tmp_path}/t" not in plan  # the counts were taken in the one scan; what is left to run reads those


def test_profiles_of_odd_tables(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 3.0), (None, 5.0), ("b", None)], "g string, x double")
    one = R.univariate(df, "x").first()
    assert (one["media"], one["moda"], one["mediana"], one["minimo"], one["maximo"]) == (3.0, 3.0, 3.0, 1.0, 5.0)
    assert one["varianza"] == pytest.approx(8 / 3) and one["desviacion"] ** 2 == pytest.approx(8 / 3)
    assert set(R.univariate(df.limit(0), "x").first().asDict().values()) == {None}
    got = {r["g"]: (r["n"], r["media"], r["mediana"], r["sd"]) for r in R.grouped_stats(df, "g", "x").collect()}
    assert got["b"] == (1, None, None, None) and got[None] == (1, 5.0, 5.0, None) and got["a"][:3] == (3, pytest.approx(7 / 3), 3.0)
    assert {r["g"]: (r["n"], r["mediana"]) for r in R.group_median(df, "g", "x").collect()} == {"a": (3, 3.0), "b": (1, None), None: (1, 5.0)}
    far = spark.createDataFrame([(1e9 + v,) for v in (0.1, 0.2, 0.3)], "x double")
    assert R.describe(far, ["x"]).first()["desviacion"] == pytest.approx(0.1, rel=1e-6)
