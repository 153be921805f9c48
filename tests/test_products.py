import datetime as dt

import pytest
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.functions import combo_label, combo_listed
from saleslens.operators import products as P

D = dt.date


@pytest.fixture
def products(spark):
    return spark.createDataFrame([
        ("one", "savings_account", D(2021, 3, 1)),
        ("same_day", "savings_account", D(2021, 3, 1)),
        ("same_day", "credit_card", D(2021, 3, 1)),
        ("three", "insurance", D(2022, 1, 1)),
        ("three", "checking_account", D(2020, 1, 1)),
        ("three", "investment_account", D(2021, 1, 1)),
        ("repeated", "credit_card", D(2020, 5, 1)),
        ("repeated", "credit_card", D(2020, 6, 1)),
        ("undated", "insurance", None),
        ("undated", "credit_card", D(2020, 5, 1)),
        ("only_undated", "insurance", None),
        ("unknown", "crypto", D(2020, 5, 1)),
        (None, "insurance", D(2020, 5, 1)),
    ], S.PRODUCTS)


def by_user(df):
    return {r["user_id"]: r.asDict() for r in df.collect()}


def test_flags_need_a_date(products):
    got = by_user(P.ownership_flags(products))
    assert not got["undated"]["insurance"] and got["undated"]["credit_card"]
    assert got["three"]["investment"] and got["three"]["insurance"]
    assert not any(got["unknown"][p] for p in S.PRODUCT_FLAGS)
    assert None not in got and set(got) == {"one", "same_day", "three", "repeated", "undated", "only_undated", "unknown"}


def test_first_and_second(products):
    got = by_user(P.first_second(products))
    assert (got["three"]["primer_producto"], got["three"]["segundo_producto"]) == ("checking_account", "investment")
    assert (got["same_day"]["primer_producto"], got["same_day"]["segundo_producto"]) == ("credit_card", "savings_account")
    assert got["repeated"]["segundo_producto"] == "credit_card"
    assert got["one"]["segundo_producto"] is None and got["undated"]["segundo_producto"] is None
    assert "only_undated" not in got


@pytest.mark.parametrize("variant,expected", [
    ("v12", (D(1900, 1, 1) - D(2021, 3, 1)).days), ("zero", 0), ("null", None)])
def test_days_between_of_a_single_product(products, variant, expected):
    got = by_user(P.product_features(products, second_variant=variant))
    assert got["one"]["dias_entre_productos"] == expected
    assert got["three"]["dias_entre_productos"] == 366


def test_tenure_number_and_label(products):
    got = by_user(P.product_features(products))
    assert got["one"]["antiguedad_cliente"] == (D(2024, 1, 1) - D(2021, 3, 1)).days
    assert got["repeated"]["numero_productos"] == 1 and got["three"]["numero_productos"] == 3
    assert got["three"]["combinacion_productos"] == "multi_producto"
    assert got["same_day"]["combinacion_productos"] == "credit_card + savings_account"
    assert got["unknown"]["combinacion_productos"] == "sin_productos"


def test_listed_labels(spark):
    flags = {p: F.col(p) for p in S.PRODUCT_FLAGS}
    df = spark.createDataFrame([
        (False, True, True, False, False), (False, False, False, True, False), (False, False, False, False, False),
        (True, True, False, False, False)], S.PRODUCT_FLAGS)
    got = df.select(combo_listed(flags).alias("a"), combo_label(flags).alias("b")).collect()
    assert [r["a"] for r in got] == ["credit_card + savings_account"] + ["OTRA_COMBINACION"] * 3
    assert [r["b"] for r in got] == ["credit_card + savings_account", "insurance", "sin_productos",
                                     "checking_account + savings_account"]


def test_ranking_is_limited_before_the_shuffle(products):
    plan = P.first_second(products)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_a_hot_customer_counts_like_any_other(spark):
    many = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 500).cast("string"))).alias("user_id"),
        F.lit("credit_card").alias("product_type"), F.date_add(F.lit("2020-01-01"), (F.col("id") % 700).cast("int")).alias("contract_date"))
    assert by_user(P.first_second(many))["hot"]["fecha_primer_producto"] == D(2020, 1, 1)
    assert by_user(P.types_by_own_count(many).select(
        F.col("total_productos").cast("string").alias("user_id"), "n"))["6667"]["n"] == 6667
    assert P.with_own_count(many).where("user_id = 'hot' AND total_productos = 6667").count() == 6667


def test_full_numbering(products, spark):
    got = {(r["user_id"], str(r["contract_date"]), r["product_type"]): r["rank"] for r in P.running_number(products).collect()}
    assert got[("three", "2022-01-01", "insurance")] == 3 and got[("same_day", "2021-03-01", "savings_account")] == 2
    hot = spark.range(5000).select(F.lit("hot").alias("user_id"), F.lit("credit_card").alias("product_type"),
                                   F.date_add(F.lit("2020-01-01"), (F.col("id") % 300).cast("int")).alias("contract_date"))
    numbered = P.running_number(hot)
    assert sorted(r["rank"] for r in numbered.collect()) == list(range(1, 5001))
    assert numbered.where("contract_date = '2020-01-02'").agg(F.min("rank"), F.max("rank")).first()[:] == (18, 34)


def test_combinations_are_sorted_and_distinct(products):
    got = by_user(P.combinations(products))
    assert got["three"]["combinacion"] == "checking_account + insurance + investment_account"
    assert got["repeated"]["combinacion"] == "credit_card"
